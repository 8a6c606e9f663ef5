"""Token files of directly addressable codes.

Format.  A folder has two tables.  `segments`: rows of up to SEGMENT_TOKENS ids (a longer
document has a segment of its own) with part, segment, local_start (ids before it in its
part), n_tokens, doc_ids and doc_ends (little-endian int64: the documents and where each
ends in the segment), n_null (how many of the first documents have no id), and one entry for each chunk level in three lists: `chunks` (low
CHUNK_BITS bits of each value that reaches the level, a byte each), `bitmaps` (a bit for each
of them, least significant first: the value goes on in the next level) and `ranks`
(little-endian uint32: bits set before each RANK_BITS bits).  `parts`: part, start (ids in
all parts before it).  Parts and segments follow ascending doc_id.  A token is found by its
place: its chunk at level 0, and while its bit is set, the chunk at the rank of that bit one
level down.  Nothing else is decoded.

Parts are ranges of doc_id of about as many bytes of text each, from the sums of MARKS ranges.
Tables are written by Spark, so lost executors leave no half files, and any store that Spark
writes to will do.  Defined results: a null text has only the end id; null doc_ids come
first; repeated doc_ids are kept, in the order of their ids; an empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT_TOKENS = 1 << 20
CHUNK_BITS = 8
RANK_BITS = 512
#: Parts of a file at most: bounds the table of part starts.
MAX_PARTS = 4096

#: Ranges of keys that are measured to cut parts, at most.
MARKS = 4096

SEGMENTS = "part int, segment int, local_start long, n_tokens long, doc_ids binary, doc_ends binary, n_null int, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


def pack(values: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """The levels (chunks, bitmap, rank directory) of unsigned values."""
    levels, rest = [], values.astype(np.uint32)
    while True:
        upper = rest >> CHUNK_BITS
        more = upper > 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(counts)))[:-1] if len(counts) else counts
        levels.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), before.astype("<u4").tobytes()))
        if not more.any():
            return levels
        rest = upper[more]


def unpack(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All values of a segment."""
    below = None
    for chunk, bits in zip(reversed(chunks), reversed(bitmaps), strict=True):
        values = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        if below is not None:
            more = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(values), bitorder="little").astype(bool)
            values[more] |= below << CHUNK_BITS
        below = values
    return below


def token_at(place: int, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> int:
    """One value of a segment by its place, from one chunk a level."""
    value, shift = 0, 0
    for chunk, bits, rank in zip(chunks, bitmaps, ranks, strict=True):
        value |= chunk[place] << shift
        if not bits[place >> 3] >> (place & 7) & 1:
            break
        block = place // RANK_BITS
        before = int.from_bytes(rank[4 * block : 4 * block + 4], "little")
        first = block * RANK_BITS // 8
        inside = int.from_bytes(bits[first : (place >> 3) + 1], "little") & ((1 << (place - block * RANK_BITS)) - 1)
        place, shift = before + inside.bit_count(), shift + CHUNK_BITS
    return value


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows part, doc_id, ids (little-endian, of 2 bytes, or 4 if wide), wide, sorted, to rows of SEGMENTS."""
    part, segment, start = None, 0, 0
    docs: list[int | None] = []
    lots: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal segment, start, docs, lots, held
        ids = np.concatenate(lots)
        levels = pack(ids)
        row = {"part": [part], "segment": [segment], "local_start": [start], "n_tokens": [len(ids)]}
        row["doc_ids"] = [np.array([0 if x is None else x for x in docs], "<i8").tobytes()]
        row["n_null"] = [sum(x is None for x in docs)]
        row["doc_ends"] = [np.cumsum([len(x) for x in lots]).astype("<i8").tobytes()]
        row |= {k: [[x[n] for x in levels]] for n, k in enumerate(("chunks", "bitmaps", "ranks"))}
        segment, start, docs, lots, held = segment + 1, start + len(ids), [], [], 0
        return pa.RecordBatch.from_pydict(row, _schema())

    for batch in batches:
        for p, doc, raw, wide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            ids = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2").astype(np.uint32)
            if docs and (p != part or held + len(ids) > most):
                yield flush()
            if p != part:
                part, segment, start = p, 0, 0
            docs.append(doc)
            lots.append(ids)
            held += len(ids)
    if docs:
        yield flush()


def _schema() -> pa.Schema:
    many = pa.list_(pa.binary())
    return pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_ends", pa.binary()), ("n_null", pa.int32()), ("chunks", many), ("bitmaps", many), ("ranks", many)])


def _places(keys: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range of each key; null is in the first one."""
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, keys.fill_null(0).to_numpy(zero_copy_only=False), side="left"))


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """The last keys of parts but the last, from keys and lengths alone, so that the texts are encoded once."""
    n = min(MARKS, 16 * parts)
    found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), 20 * n).alias("b")).first()["b"] if parts > 1 else None
    marks = np.unique(np.array(found or [], np.int64))
    if not len(marks):
        return marks
    place = F.arrow_udf(lambda keys: pa.array(_places(keys, marks), pa.int32()), "int")(F.col("doc_id"))
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"))
    held = np.zeros(len(marks) + 1)
    for x in sized.groupBy(place.alias("k")).agg(F.sum("n").alias("n")).collect():  # MARKS rows
        held[x["k"]] = x["n"]
    upto = np.cumsum(held)
    # a part ends at the first mark from which on it has its share
    return marks[np.unique(np.searchsorted(upto[:-1], upto[-1] * np.arange(1, parts) / parts).clip(max=len(marks) - 1))]


def write(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode the texts, append end_id to each, and write the ids to path in ascending order of key."""
    from siltflow.llm import bpe, storage

    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = min(MAX_PARTS, max(1, storage.partitions(spark)))
    bounds = _bounds(docs, parts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # chunks of several batches, so that a word is encoded once for more text
        for table in bpe.chunks(batches):
            row, keys = 0, table.column(1).combine_chunks()
            for ids, ends in bpe.encode_column(table.column(0).combine_chunks(), tokenizer):
                n = len(ends) - 1
                own = keys.slice(row, n)
                row += n
                full = np.insert(ids.astype("<u4"), ends[1:], end_id)
                wide = bool(len(full) and full.max() > 0xFFFF)
                offsets = (ends + np.arange(n + 1)) * (4 if wide else 2)
                full = full.astype("<u4" if wide else "<u2").tobytes()
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays([pa.array(_places(own, bounds), pa.int32()), own, raw, pa.array([wide] * n)], ["part", "doc_id", "ids", "wide"])

    rows = docs.select("text", "doc_id").mapInArrow(coded, "part int, doc_id long, ids binary, wide boolean")
    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(lambda batches: _segments(batches, segment_tokens), SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    sums = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # MAX_PARTS rows at most
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/parts")


def _opened(spark: SparkSession, path: str) -> DataFrame:
    starts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(F.broadcast(starts), "part")  # MAX_PARTS rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a file: doc_id, start (ids before it), ids (little-endian uint32 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, ends, n_null, chunks, bitmaps in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                values = unpack(chunks, bitmaps).astype("<u4")
                doc = np.frombuffer(docs, "<i8")
                offsets = np.concatenate(([0], np.frombuffer(ends, "<i8")))
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=np.arange(len(doc)) < n_null), pa.array(first + offsets[:-1]), raw], ["doc_id", "start", "ids"])

    rows = _opened(spark, path).select((F.col("start") + F.col("local_start")).alias("first"), "doc_ids", "doc_ends", "n_null", "chunks", "bitmaps")
    return rows.mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """The id at each place of the whole file: place, id.  Only the addressed chunks are read from a segment's bytes; places outside have no row."""
    from siltflow.llm import storage

    base = _opened(spark, path).select((F.col("start") + F.col("local_start")).alias("first"), "n_tokens", "chunks", "bitmaps", "ranks")
    block = lambda c: F.floor(c / SEGMENT_TOKENS)
    index = base.select("first", "n_tokens", F.explode(F.sequence(block(F.col("first")), block(F.col("first") + F.col("n_tokens") - 1))).alias("block"))
    asked = places.select(F.col(place).cast("long").alias("place")).where("place >= 0").distinct().withColumn("block", block(F.col("place")))
    found = asked.join(index, "block").where("place >= first AND place < first + n_tokens").groupBy("first").agg(F.collect_list("place").alias("places"))  # SEGMENT_TOKENS places a segment at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, asked, chunks, bitmaps, ranks in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                yield pa.RecordBatch.from_pydict({"place": asked, "id": [token_at(x - first, chunks, bitmaps, ranks) for x in asked]}, pa.schema([("place", pa.int64()), ("id", pa.int64())]))

    joined = found.join(base, "first").select("first", "places", "chunks", "bitmaps", "ranks").repartition(storage.partitions(spark), "first")
    return joined.mapInArrow(run, "place long, id long")
