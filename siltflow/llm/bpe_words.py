"""BPE of many distinct words at once, on numpy arrays.

The library encodes word by word; here the merges of all words of a batch go on side by side:
in each round every piece applies its pair of lowest rank, everywhere in the piece from the
left, until no piece has a pair that the merges list.  That gives the ids of the public BPE
algorithm, which the tests hold against the library.  The array way serves files that lower-case,
split by the pattern below and mark word ends (as the `word_bpe` file does), for words of
characters below U+0300 (no composition there) without special tokens; all other words go to
the library.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltflow.llm.textarrays import text_bytes

#: The pre-tokenizer's pattern that `_pieces` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of a word from which the library encodes it: a round works on all that is left of a piece.
LONG_WORD = 128
#: Bytes of words that are merged at once.
BATCH_BYTES = 1 << 18

_NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_LOW = 0x300
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each low character: its class, its lower case, and whether that is one character of two bytes at most."""
    kind, lower, plain = np.full(_LOW, _OTHER, np.int8), np.zeros(_LOW, np.uint32), np.ones(_LOW, bool)
    for k in range(_LOW):
        low = chr(k).lower()
        plain[k] = len(low) == 1 and ord(low) < _LOW
        lower[k] = ord(low) if plain[k] else k
        category = unicodedata.category(low[0])[0]
        kind[k] = _SPACE if k in _WHITE else _LETTER if category == "L" else _DIGIT if category == "N" else _OTHER
    return kind, lower, plain


def byte_chars() -> dict[int, str]:
    """The printable stand-ins that byte-level tokenizers have for the 256 bytes: printable Latin-1 stands for itself, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(own)]
    return {x: chr(x) for x in own} | {x: chr(256 + k) for k, x in enumerate(rest)}


class WordEncoder:
    """Ids of words, and of whole texts, under a `tokenizers` file."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = next((x for x in before if x["type"] == "Split"), None)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        model, chars = spec["model"], byte_chars()
        vocabulary = model.get("vocab", {})
        #: whether ids of a text are those of its words, one after the other, and words can be merged in arrays
        self.by_word = (
            bool(split)
            and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and split["pattern"].get("Regex") == PATTERN
            and split["behavior"] == "Removed"
            and split["invert"]
            and kinds == ["NFC", "Replace", "Lowercase"]
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix") == "</w>"
            and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and not any(any(c.isspace() for c in x) for x in self.specials)
            and all(c + end in vocabulary for c in chars.values() for end in ("", "</w>"))
            and len(vocabulary) <= 1 << 16
        )
        if self.by_word:
            self._kind, self._lower, self._plain = _tables()
            self._inner = np.array([vocabulary[chars[k]] for k in range(256)], np.int32)
            self._final = np.array([vocabulary[chars[k] + "</w>"] for k in range(256)], np.int32)
            merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
            keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in merges], np.uint32)
            order = np.argsort(keys, kind="stable")
            self._keys, self._ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
            self._merged = np.array([vocabulary[a + b] for a, b in merges] + [0], np.int32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole texts, by the library, and how many each text has."""
        lists = [self.whole.encode(x, add_special_tokens=False).ids for x in texts]
        return np.array([k for x in lists for k in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, none of which has ASCII white space, and how many each word has."""
        if not self.by_word:
            raise ValueError("this tokenizer's ids are not those of words")
        sizes = np.zeros(len(words), np.int64)
        fast = self._able(words)
        lots: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero(fast)
        own = words if fast.all() else words.filter(pa.array(fast))
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))))
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, side="right")) - 1)
            ids, n = self._merge(own.slice(at, stop - at))
            sizes[rows[at:stop]] = n
            lots.append((ids, n))
            at = stop
        if len(rows) == len(words):
            return (np.concatenate([x for x, _ in lots]) if lots else np.zeros(0, np.int32)), sizes
        slow = np.flatnonzero(~fast)
        others, n = self.texts(words.filter(pa.array(~fast)).to_pylist())
        sizes[slow] = n
        begins = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(int(begins[-1]), np.int32)
        for at, held, count in ((rows, np.concatenate([x for x, _ in lots]) if lots else others[:0], sizes[rows]), (slow, others, n)):
            first = np.cumsum(count) - count
            out[np.repeat(begins[at] - first, count) + np.arange(len(held))] = held
        return out, sizes

    def _able(self, words: pa.Array) -> np.ndarray:
        """Which words the array way serves."""
        if not len(words):
            return np.zeros(0, bool)
        length = pc.binary_length(words).to_numpy(zero_copy_only=False)
        able = (length > 0) & (length <= LONG_WORD)
        raw, ends = text_bytes(words)
        if len(raw):
            # lead bytes of characters from U+0300 on are CC and above; the rest have classes of their own
            odd = raw >= 0xCC
            if not self._plain.all():
                bad = [chr(k).encode() for k in np.flatnonzero(~self._plain)]
                for x in bad:
                    odd[:-1] |= (raw[:-1] == x[0]) & (raw[1:] == x[1])
            hits = np.flatnonzero(odd)
            able[np.searchsorted(ends, hits, side="right") - 1] = False
        for x in self.specials:
            found = pc.match_substring(words, x)
            if pc.any(found).as_py():
                able &= ~found.to_numpy(zero_copy_only=False)
        return able

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in lower case without white space, whether each begins a piece, and its word."""
        raw, _ = text_bytes(words)
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind, low = self._kind[code], self._lower[code]
        n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), n)
        begins = np.ones(len(code), bool)
        begins[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        marks = np.flatnonzero((low == 39) & (begins | (np.concatenate(([_SPACE], kind[:-1])) != _OTHER)))
        if len(marks):
            self._contractions(marks, low, word, begins, kind)
        keep = kind != _SPACE
        if not keep.all():
            low, begins, word = low[keep], begins[keep], word[keep]
        two = low >= 0x80
        if not two.any():
            return low.astype(np.uint8), begins, word
        place = np.cumsum(two) - two + np.arange(len(low))
        data = np.empty(len(low) + int(two.sum()), np.uint8)
        data[place] = np.where(two, 0xC0 | low >> 6, low)
        data[place[two] + 1] = 0x80 | low[two] & 0x3F
        heads = np.zeros(len(data), bool)
        heads[place] = begins
        return data, heads, np.repeat(word, np.where(two, 2, 1))

    @staticmethod
    def _contractions(marks: np.ndarray, low: np.ndarray, word: np.ndarray, begins: np.ndarray, kind: np.ndarray) -> None:
        """An apostrophe where a piece begins takes one of s t m d, or re ve ll, into its piece."""
        padded, words = np.concatenate((low, np.zeros(2, low.dtype))), np.concatenate((word, np.full(2, -1, word.dtype)))
        one = np.where(words[marks + 1] == word[marks], padded[marks + 1], 0)
        two = np.where(words[marks + 2] == word[marks], padded[marks + 2], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        for k in (2, 3):
            at = marks[size == k]
            begins[at] = True
            for j in range(1, k):
                begins[at + j] = False
            after = at + k
            after = after[after < len(low)]
            begins[after] = True

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def _merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, heads, word = self._pieces(words)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        last = np.concatenate((heads[1:], [True]))
        out = np.where(last, self._final[data], self._inner[data])
        alive = np.ones(len(out), bool)  # symbols that no merge has taken into the one before
        # what is still at work: symbols, their places in out, whether each ends its piece, ranks with the next one
        symbol, place, end = out.copy(), np.arange(len(out), dtype=np.int32), last
        rank = np.full(len(out), _NONE, np.int32)
        inner = np.flatnonzero(~end)
        rank[inner] = self._rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], end[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbol)))
            going = best != _NONE
            if not going.all():
                keep = np.repeat(going, size)
                symbol, place, end, rank = symbol[keep], place[keep], end[keep], rank[keep]
                best, size = best[going], size[going]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            if len(at) > 1:  # of a run such as a a a, every second pair from the left
                breaks = np.concatenate(([True], np.diff(at) != 1))
                run = np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            merged = self._merged[rank[at]]
            symbol[at] = merged
            out[place[at]] = merged
            end[at] = end[at + 1]
            alive[place[at + 1]] = False
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))
            symbol, place, end, rank = symbol[keep], place[keep], end[keep], rank[keep]
            rank[now] = _NONE
            after = now[~end[now]]
            rank[after] = self._rank(symbol[after], symbol[after + 1])
            before = now[now > 0] - 1
            before = before[~end[before]]
            rank[before] = self._rank(symbol[before], symbol[before + 1])
        return out[alive], np.bincount(word[alive], minlength=len(words)).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
