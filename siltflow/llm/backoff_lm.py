"""Language-model scores with stupid backoff.

Words are lower-cased runs (bytes other than 20 and 09 to 0D).  With c the counts of n-grams
over all documents and N the number of words,

    S(w | u) = c(u w) / c(u)                        where c(u w) >= min_count,
    S(w | u) = 0.4 * S(w | u without its first word)  else,  and  S(w) = c(w) / N,

and a document's score is the mean of ln S over its words; the first words of a document have
shorter contexts, without penalty.

Documents are dealt to chunks by a hash of their id.  A chunk asks for each distinct n-gram
once, with its own count; requests are dealt by the n-gram's hash, so that each part of the
count tables is one bucket, and a very common n-gram is one request a chunk.  Requests are
ascending and travel as differences, counts as planes of bytes.  A bucket sums
and answers in the order of the requests; the chunk joins the answers to its exploded
n-grams and sums by document.  N-grams are told apart by their bucket and 48 bits of hash.

Defined results: null, empty and blank texts have no words and a null score; repeated rows
are counted and scored each; null ids are scored; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.llm import storage
from siltflow.llm.textarrays import _PLACE, _splitmix, text_slices, word_hashes

BACKOFF = 0.4
#: Chunks for each shuffle partition; a chunk's n-grams are in memory at once.
CHUNKS = 3


def _grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n up to order, the hash of the n-gram that ends at each word (0 where the document begins too near), and the first word of each text, with the end."""
    words, starts, base = [], [np.zeros(1, np.int64)], 0
    for a, b in text_slices(texts):
        own, at = word_hashes(texts.slice(a, b - a))
        words.append(own)
        starts.append(at[1:] + base)
        base += len(own)
    word = np.concatenate(words) if words else np.zeros(0, np.uint64)
    first = np.concatenate(starts)
    since = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    out, total = [], np.zeros(len(word), np.uint64)
    for n in range(order):
        shifted = np.zeros(len(word), np.uint64)
        shifted[n:] = word[: len(word) - n] * _PLACE[n]
        total = total + shifted
        code = _splitmix(total + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) | np.uint64(1)
        code[since < n] = 0
        out.append(code)
    return out, first


def _keys(grams: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (bucket, 48 bits), their buckets and counts, and the place of each entry of grams, one after the other."""
    both = np.concatenate(grams)
    bucket = (both >> np.uint64(48)) % np.uint64(buckets)
    key = (bucket << np.uint64(48)) | (both & np.uint64((1 << 48) - 1))
    values, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    return values, (values >> np.uint64(48)).astype(np.int32), counts, place


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number: all lowest bytes, then all second ones, and so on."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys of 48 bits and their counts: low halves of the differences, which don't compress, and the rest."""
    step = np.diff(keys, prepend=np.uint64(0))
    return step.astype("<u4").tobytes(), zlib.compress(_planes(step >> np.uint64(32), 2) + _planes(counts, 6), 1)


def _unpack(low: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(rest), np.uint8)
    n = len(raw) // 8
    step = (_from_planes(raw[: 2 * n], 2) << np.uint64(32)) | np.frombuffer(low, "<u4").astype(np.uint64)
    return np.cumsum(step, dtype=np.uint64), _from_planes(raw[2 * n :], 6).astype(np.int64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, n_backoff (words whose longest context failed) and score of each document."""
    spark = docs.sparkSession
    buckets = storage.partitions(spark)
    chunks = CHUNKS * buckets
    chunk = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.length("text")), F.lit(chunks)).cast("int")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.withColumn("chunk", chunk).repartition(buckets, "chunk")

    def requests(held: pa.Table) -> pa.Table:
        grams, _ = _grams(held["text"].combine_chunks(), order)
        values, bucket, counts, _ = _keys(grams, buckets)
        number = held["chunk"][0].as_py() if held.num_rows else 0
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                out.append((k, number, *_pack(values[a:b] & np.uint64((1 << 48) - 1), counts[a:b])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "chunk": pa.array([x[1] for x in out], pa.int32()), "entries": pa.array([x[2] for x in out], pa.binary()), "rest": pa.array([x[3] for x in out], pa.binary())})

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for bucket, number, low, rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held.setdefault(bucket, []).append((number, low, rest))
        for bucket in list(held):
            parts = held.pop(bucket)
            numbers, sizes = [x[0] for x in parts], [len(x[1]) // 4 for x in parts]
            keys, counts = zip(*(_unpack(x[1], x[2]) for x in parts), strict=True)
            del parts
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            total = np.bincount(inverse, np.concatenate(counts))[inverse].astype(np.uint64)
            at = 0
            for number, size in zip(numbers, sizes, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([bucket], pa.int32()), pa.array([zlib.compress(_planes(total[at : at + size], 6), 1)], pa.binary())], ["chunk", "bucket", "counts"])
                at += size

    def joined(held: pa.Table, got: pa.Table) -> pa.Table:
        texts = held["text"].combine_chunks() if held.num_rows else pa.array([], pa.string())
        grams, first = _grams(texts, order)
        _, _, _, place = _keys(grams, buckets)
        by = sorted(zip(got["bucket"].to_pylist(), got["counts"].to_pylist(), strict=True))
        told = [_from_planes(np.frombuffer(zlib.decompress(x[1]), np.uint8), 6) for x in by]
        counts = np.concatenate(told).astype(np.float64) if told else np.zeros(0)
        n = len(grams[0])
        found = [np.where(g == 0, 0, counts[place[k * n : (k + 1) * n]]) for k, g in enumerate(grams)]
        # the context of a word's n-gram is the n-gram of one word less that ends before it
        before = [np.concatenate(([0.0], x[:-1])) if n else x for x in found]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.log(found[0])
            unigram = np.ones(n, bool)
            failed = np.zeros(n, bool)
            for k in range(1, order):
                there = grams[k] != 0
                ok = there & (found[k] >= min_count)
                value = np.where(ok, np.log(found[k]) - np.log(before[k - 1]), np.where(there, value + np.log(BACKOFF), value))
                unigram &= ~ok
                failed = np.where(there, ~ok, failed)

        def summed(x: np.ndarray) -> np.ndarray:
            # each document by itself, so that its sum doesn't depend on its neighbours
            out = np.zeros(len(first) - 1)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                out[some] = np.add.reduceat(x.astype(np.float64), first[:-1][some])
            return out

        return pa.table({"doc_id": held["doc_id"], "n_words": pa.array(np.diff(first)), "n_backoff": pa.array(summed(failed).astype(np.int64)), "value": pa.array(summed(value)), "n_unigram": pa.array(summed(unigram).astype(np.int64))})

    kind = docs.schema[key].dataType.simpleString()
    asked = dealt.groupBy("chunk").applyInArrow(requests, "bucket int, chunk int, entries binary, rest binary")
    told = asked.repartition(buckets, "bucket").mapInArrow(answers, "chunk int, bucket int, counts binary")
    parts = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(joined, f"doc_id {kind}, n_words long, n_backoff long, value double, n_unigram long")
    parts = storage.materialize(parts, "backoff-sums")
    words = parts.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    mean = (F.col("value") - F.col("n_unigram") * float(np.log(max(1, words)))) / F.col("n_words")
    return parts.select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, mean).alias("score"))
