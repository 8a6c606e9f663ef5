"""Texts of Arrow batches as numpy arrays of words and shingles, a few MB at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart at once; a longer text is taken by itself.
CHUNK_BYTES = 1 << 19

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library

    def _trim(_: int) -> int:
        return 0


def release() -> None:
    """Give freed memory back: idle workers stay alive beside the JVM's heap, with what their allocators keep."""
    pa.default_memory_pool().release_unused()
    _trim(0)


_MASK = (1 << 64) - 1
_STEP = 0xD1342543DE82EF95  # odd, 5 modulo 8: its powers differ in their low bits


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = _splitmix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        back = pow(_STEP, -1, 1 << 64)
        for name, step in (("up", _STEP), ("down", back)):
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have `limit` bytes together at most, or one row each."""
    ends = _offsets(column)
    n, row = len(column), 0
    while row < n:
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop
        row = stop


def _offsets(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins, with the end; null has none."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    ends = _offsets(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def runs(raw: np.ndarray, starts: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of bytes that aren't `outside` begins and ends; none crosses the start of a text."""
    inside = ~outside[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < len(raw)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rolling(raw: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each begin to its end, given rolling(raw)."""
    _, down = _power_tables(len(total))
    codes = (total[end] - total[begin]) * down[begin]
    return _splitmix(codes + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than 20 and 09 to 0D) of all texts, and the first word of each text, with the end."""
    raw, starts = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    if lower:
        raw = _LOWER[raw]
    begin, end = runs(raw, starts)
    return span_hashes(rolling(raw), begin, end), np.searchsorted(begin, starts)


_PLACE = _splitmix((np.arange(64, dtype=np.uint64) + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending: of `width` words each, or all its words where it has fewer."""
    n = len(words)
    if n >= width:
        sums = words[: n - width + 1] * _PLACE[0]
        for k in range(1, width):
            sums = sums + words[k : n - width + 1 + k] * _PLACE[k]
        full = _splitmix(sums + np.uint64(width * 0x5851F42D4C957F2D & _MASK))
    else:
        full = words[:0]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        count = b - a
        if count >= width:
            own = np.sort(full[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
        elif count:
            some = (words[a:b] * _PLACE[:count]).sum(dtype=np.uint64).reshape(1)
            yield _splitmix(some + np.uint64(count * 0x5851F42D4C957F2D & _MASK))
        else:
            yield words[:0]
