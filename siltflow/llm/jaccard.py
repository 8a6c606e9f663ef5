"""Exact n-gram Jaccard join by a blocked sparse product of documents by n-grams.

Rows of the incidence matrix are distinct shingle sets (copies are one row with a weight),
columns are 64-bit shingle hashes.  Entries that cannot matter go before the product:

1. Shingle columns are dealt to buckets by hash, packed; what a task finds in two documents it
   counts there, so that a very common shingle leaves each task as one entry.  Each set learns
   how many of its shingles any other set has.  A link needs 0.8 of them at least
   (overlap >= 0.8 * union), so sets below that bound are dropped.
2. Among the rest, only the rarest n - ceil(0.8 n) + 1 shingles of a set of n can be all
   missed by a partner; sets that share one of these are joined as stars, and the components
   of these stars hold every possible pair.
3. Within a component, sets are ordered by size and cut into blocks of bounded numbers of sets
   and shingles; only block pairs that share a rare shingle, and whose sizes differ by no more
   than the bound, are kept.  Each of these pairs of blocks is a product of two
   sparse slices, taken over slices of columns that accumulate overlap counts; it ends early
   when no pair can still reach its bound.  It returns a row for each set, its root among the
   links found there and its number of links, never the pairs.

Defined results: null, empty and blank texts have no shingles, no links, and their own id as
class; repeated rows are copies, and rows of one id with different texts are judged each by its
own text (classes are numbered, never known by an id); null ids take no part in classes and get the class of an
equal text; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.llm import storage
from siltflow.llm.components import components
from siltflow.llm.textarrays import _splitmix, release, shingle_hashes, text_slices, word_hashes

BROADCAST_ROWS = 1_000_000
#: Parts of the sets of one size in a component while they are numbered.
SALTS = 16
#: Buckets of shingles for each shuffle partition; a bucket's entries are in memory at once.
BUCKETS = 4
#: Shingles of a row at most: rows of one size make batches of bounded size, however long texts are.
PIECE = 2048


@dataclass(frozen=True)
class Sizes:
    """How much is worked on at once; results don't depend on it."""

    #: Shingles that a task holds before it deals them.
    held: int = 1 << 19
    #: Sets of a block, and shingles of a block (a larger set is a block of its own).
    block: int = 256
    grams: int = 1 << 18
    #: Columns of a slice of the product.
    columns: int = 4096
    #: Bits that stand for a set while entries are dealt, 32 at most; sets that share them skip the count test.
    owner_bits: int = 32


_SHARED = np.uint64(0xFFFFFFFF)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for a, b in text_slices(texts):
        words, starts = word_hashes(texts.slice(a, b - a))
        yield from shingle_hashes(words, starts, width)


def _print(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set."""
    with np.errstate(over="ignore"):
        one = _splitmix(grams).sum(dtype=np.uint64)
        two = _splitmix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def set_rows(docs: DataFrame, width: int, grams: bool) -> DataFrame:
    """doc_id, n (shingles), one, two (which stand for the set), and with `grams` the shingles' bytes, in rows of PIECE shingles at most with their number as piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1), 2 << 20):
                at, sizes, ones, twos, pieces, raw = [], [], [], [], [], []
                for k, own in enumerate(_sets(batch.column(1).slice(a, b - a), width)):
                    one, two = _print(own)
                    for piece in range(max(1, -(-len(own) // PIECE)) if grams else 1):
                        at.append(a + k)
                        sizes.append(len(own))
                        ones.append(one)
                        twos.append(two)
                        pieces.append(piece)
                        raw.append(own[piece * PIECE : (piece + 1) * PIECE].tobytes() if grams else b"")
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (sizes, ones, twos))]
                names = ["doc_id", "n", "one", "two"]
                if grams:
                    columns, names = [*columns, pa.array(pieces, pa.int32()), pa.array(raw, pa.binary())], [*names, "piece", "grams"]
                whole = pa.RecordBatch.from_arrays(columns, names)
                # a very long text has many pieces: a batch has a bounded number of them
                for first in range(0, whole.num_rows, storage.BATCH_ROWS):
                    yield whole.slice(first, storage.BATCH_ROWS)
            release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, one long, two long" + ", piece int, grams binary" * grams)


def _owner(one: np.ndarray, bits: int) -> np.ndarray:
    """Bits that stand for a set while entries are dealt; never _SHARED."""
    return np.minimum(one >> np.uint64(64 - bits), _SHARED - np.uint64(1))


def shared_counts(docs: DataFrame, width: int, sizes: Sizes) -> DataFrame:
    """owner, n_shared: how many shingles of a set others have, or more than that when hashes meet; too few where two sets have one owner."""
    parts = storage.partitions(docs.sparkSession)
    buckets = BUCKETS * parts
    bits = sizes.owner_bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[int] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            gram = np.concatenate(held)
            owner = np.repeat(np.array(owners, np.uint64), [len(x) for x in held])
            order = np.argsort(gram)
            gram, owner = gram[order], owner[order]
            same = gram[1:] == gram[:-1]
            often = np.concatenate((same, [False])) | np.concatenate(([False], same))
            values, counts = np.unique(owner[often], return_counts=True)
            keep = ~often | np.concatenate(([True], ~same))  # one entry of each shingle
            owner = np.where(often, _SHARED, owner)[keep]
            gram = gram[keep]
            bucket = ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            entry = (gram << np.uint64(32)) | owner
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            entry = entry[order]
            rows = [(k, entry[cuts[k] : cuts[k + 1]].tobytes()) for k in range(buckets) if cuts[k + 1] > cuts[k]]
            rows.append((-1 - int(gram[0] % np.uint64(buckets)), np.stack((values, counts.astype(np.uint64))).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for own in _sets(batch.column(0), width):
                if not len(own):
                    continue
                both = _print(own)
                if both in seen:
                    continue
                seen.add(both)
                held.append(own)
                owners.append(int(_owner(np.array([both[0]]).view(np.uint64), bits)[0]))
                size += len(own)
                if size >= sizes.held:
                    yield from flush()
                    held, owners, seen, size = [], [], set(), 0
        if held:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket, one bucket in memory at a time."""
        owners, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        bucket, held = None, []

        def ended() -> None:
            nonlocal owners, counts
            if bucket < 0:  # sums that tasks have made of what they found in two documents
                own, n = (np.concatenate([x[k * len(x) // 2 : (k + 1) * len(x) // 2] for x in held]) for k in (0, 1))
            else:
                entry = np.concatenate(held)
                entry.sort()
                entry = entry[np.concatenate(([True], entry[1:] != entry[:-1]))]
                gram = (entry >> np.uint64(32)).astype(np.uint32)
                same = gram[1:] == gram[:-1]
                often = np.concatenate((same, [False])) | np.concatenate(([False], same))
                own = entry[often] & _SHARED
                own = own[own != _SHARED]
                n = np.ones(len(own), np.int64)
            owners, counts = summed([owners, own], [counts, n.astype(np.int64)])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = max(k, -1)
                if k != bucket:
                    if held:
                        ended()
                    bucket, held = k, []
                held.append(np.frombuffer(raw.as_buffer(), np.uint64).copy())
        if held:
            ended()
        held = []
        # counts go on packed, a row for each part of the owners
        part = (owners % np.uint64(buckets)).astype(np.int64)
        rows = [(k, np.stack((owners[part == k], counts[part == k].astype(np.uint64))).tobytes()) for k in np.unique(part).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["part", "counts"])
        release()

    def summed(owners: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, place = np.unique(np.concatenate(owners), return_inverse=True)
        return values, np.bincount(place, np.concatenate(counts), len(values)).astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(raw.as_buffer(), np.uint64).reshape(2, -1) for batch in batches for raw in batch.column(1)]
        if held:
            values, total = summed([x[0] for x in held], [x[1].astype(np.int64) for x in held])
            del held
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(total)], ["owner", "n_shared"])

    dealt = docs.select("text").mapInArrow(deal, "bucket int, entries binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    added = dealt.mapInArrow(count, "part int, counts binary").repartition(parts, "part")
    return added.mapInArrow(add, "owner long, n_shared long")


def _product(left: list[np.ndarray], right: list[np.ndarray], n_left: np.ndarray, n_right: np.ndarray, percent: int, columns: int) -> np.ndarray:
    """Which pairs of sets are linked, from overlap counts that are accumulated over slices of columns."""
    sets = left + right
    gram = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column = np.unique(gram, return_inverse=True)
    in_left = np.bincount(column[row < len(left)], minlength=len(values)) > 0
    in_right = np.bincount(column[row >= len(left)], minlength=len(values)) > 0
    both = in_left & in_right
    place = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n_columns = int(both.sum())
    overlap = np.zeros((len(left), len(right)))
    # overlap * 100 >= percent * (a + b - overlap)
    bound = percent * (n_left[:, None] + n_right[None, :]) / (100 + percent) - 1e-6
    bound[np.minimum(n_left[:, None], n_right[None, :]) * 100 < percent * np.maximum(n_left[:, None], n_right[None, :])] = np.inf
    rest = np.bincount(row, minlength=len(sets)).astype(np.float64)
    for first in range(0, n_columns, columns):
        a, b = np.searchsorted(column, (first, first + columns))
        width = min(columns, n_columns - first)
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        overlap += part[: len(left)] @ part[len(left) :].T
        rest -= part.sum(1)
        if (overlap + np.minimum(rest[: len(left), None], rest[None, len(left) :]) < bound).all():
            return np.zeros(overlap.shape, bool)
    return overlap >= bound


def _multiply(percent: int, columns: int):
    def links(pieces: list[tuple[int, int, int, int, np.ndarray]]) -> tuple[list[int], list[int], list[int]]:
        """pieces: (side, doc, n, weight, grams), a set's after each other; docs, roots and numbers of links."""
        blocks = []
        for (side, doc), own in groupby(pieces, lambda x: x[:2]):
            own = list(own)
            blocks.append((side, doc, *own[0][2:4], np.concatenate([x[4] for x in own]) if len(own) > 1 else own[0][4]))
        sides = [[x for x in blocks if x[0] == side] for side in (0, 1)]
        alone = not sides[1]
        left, right = sides[0], sides[0] if alone else sides[1]
        n = [np.array([x[2] for x in side], np.float64) for side in (left, right)]
        linked = _product([x[4] for x in left], [x[4] for x in right], *n, percent, columns)
        weights = [np.array([x[3] for x in side], np.int64) for side in (left, right)]
        if alone:
            np.fill_diagonal(linked, False)
            docs = [x[1] for x in left]
            degree = linked.astype(np.int64) @ weights[0]
            pairs = np.argwhere(np.triu(linked))
        else:
            docs = [x[1] for x in left + right]
            degree = np.concatenate((linked.astype(np.int64) @ weights[1], linked.T.astype(np.int64) @ weights[0]))
            pairs = np.argwhere(linked) + np.array([0, len(left)])
        root = list(range(len(docs)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs.tolist():
            a, b = find(a), find(b)
            if a != b:
                a, b = (a, b) if docs[a] < docs[b] else (b, a)
                root[b] = a
        return docs, [docs[find(x)] for x in range(len(docs))], degree.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            docs, roots, degrees = links(held)
            some = [k for k, x in enumerate(degrees) if x]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for k in some], pa.int64()) for x in (docs, roots, degrees)], ["doc", "root", "n_links"])

        for batch in batches:
            for comp, i, j, side, doc, n, weight, _, raw in zip(*(c if c.type == pa.binary() else c.to_pylist() for c in batch.columns), strict=True):
                if (comp, i, j) != key:
                    if held:
                        yield done()
                    key, held = (comp, i, j), []
                held.append((side, doc, n, weight, np.frombuffer(raw.as_buffer(), np.uint64).copy()))
        if held:
            yield done()
        held = []
        release()

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, sizes: Sizes | None = None) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, n_links."""
    return _judged(docs, key, text, width, percent, sizes or Sizes()).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def _judged(docs: DataFrame, key: str, text: str, width: int, percent: int, sizes: Sizes) -> DataFrame:
    """doc_id, n, one, two, component_id, root (the number of the component, null without shingles) and n_links of each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = storage.materialize(set_rows(rows, width, False), "sets")
    classes = base.where("n > 0").groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("weight"))
    # written once, so that the numbers stay
    classes = storage.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    # step 1
    owner = F.least(F.shiftrightunsigned("one", 64 - sizes.owner_bits), F.lit(0xFFFFFFFE))
    # entries of sets with one owner can't be told apart, so these sets stay whatever their count
    meeting = classes.withColumn("owner", owner).withColumn("sets", F.count("*").over(Window.partitionBy("owner")))
    counted = meeting.where("rep IS NOT NULL").join(shared_counts(rows, width, sizes), "owner", "left")
    able = storage.materialize(counted.where((F.col("sets") > 1) | (100 * F.col("n_shared") >= percent * F.col("n"))).select(F.col("rep").alias("doc_id"), "one", "two", F.col("node").alias("doc"), "weight"), "able-sets")
    near = rows.join(_small(able.select("doc_id").distinct(), able.count()), "doc_id", "left_semi")
    sets = set_rows(near, width, True).join(able, ["doc_id", "one", "two"]).select("doc", "n", "weight", "piece", "grams").dropDuplicates(["doc", "piece"])
    sets = storage.materialize(sets, "near-sets")
    # step 2
    longs = _as_longs(sets)
    entries = longs.select("doc", "n", F.explode("grams").alias("gram"))
    # counts come by a sum and a join, which adaptive execution splits, so that a very common shingle isn't one task
    shared = entries.join(entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "gram")
    gathered = shared.groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1 - (F.col("n") - F.size("g"))
    rare = gathered.where(allowed > 0).select("doc", F.explode(F.expr("slice(g, 1, int(n - ceil(n * {0} / 100 - 1e-9) + 1 - (n - size(g))))".format(percent))).alias("x")).select("doc", "x.gram")
    rare = storage.materialize(rare, "rare-shingles")
    stars = rare.join(rare.groupBy("gram").agg(F.min("doc").alias("first")), "gram").where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")).distinct()
    together = components(stars)
    # step 3
    members = together.union(together.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("doc"), F.col("root").alias("comp"))
    sized = members.join(sets.where("piece = 0").select("doc", "n"), "doc")
    # places by size within a component, counted in parts of one size and a hash so that no task sorts a whole component
    units = F.greatest(F.lit(1), F.ceil(F.col("n") * sizes.block / sizes.grams)).cast("long")
    sized = storage.materialize(sized.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).withColumn("units", units), "sized")
    before = Window.partitionBy("comp").orderBy("n", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("comp", "n", "salt").agg(F.sum("units").alias("u")).select("comp", "n", "salt", F.coalesce(F.sum("u").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("comp", "n", "salt").orderBy("doc")) - 1
    block = F.floor((F.col("start") + F.col("rank") * F.col("units")) / sizes.block)
    placed = storage.materialize(sized.withColumn("rank", rank).join(starts, ["comp", "n", "salt"]).select("doc", "comp", "n", block.alias("block")), "blocks")
    # only blocks that have a rare shingle in common can hold a pair
    bounds = placed.groupBy("comp", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = rare.join(placed.select("doc", "comp", "block"), "doc").select("gram", "comp", "block").distinct().join(bounds, ["comp", "block"])
    met = storage.materialize(met, "met")
    one, two = met.select("gram", "comp", F.col("block").alias("i"), "hi"), met.select("gram", F.col("block").alias("j"), "lo")
    pairs = storage.materialize(one.join(two, "gram").where(f"i <= j AND 100 * hi >= {percent} * lo").select("comp", "i", "j").distinct(), "block-pairs")
    held = placed.select("doc", "comp", "block").join(sets, "doc")
    left = held.join(pairs.withColumnRenamed("i", "block"), ["comp", "block"]).select("comp", F.col("block").alias("i"), "j", F.lit(0).alias("side"), "doc", "n", "weight", "piece", "grams")
    right = held.join(pairs.where("i < j").withColumnRenamed("j", "block"), ["comp", "block"]).select("comp", "i", F.col("block").alias("j"), F.lit(1).alias("side"), "doc", "n", "weight", "piece", "grams")
    dealt = left.union(right).repartition(storage.partitions(spark), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side", "doc", "piece")
    found = storage.materialize(dealt.mapInArrow(_multiply(percent, sizes.columns), "doc long, root long, n_links long"), "links")
    roots = components(found.where("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy(F.col("doc").alias("node")).agg(F.sum("n_links").alias("n_links"))
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    lowest = storage.materialize(linked.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least")), "lowest")
    named = linked.join(_small(lowest, lowest.count()), "root")
    full = classes.join(named, "node", "left").join(degree, "node", "left")
    full = full.select("one", "two", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = base.join(full, ["one", "two"], "left")
    empty = F.col("n") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "n", "one", "two", component, F.when(~empty, F.col("root")).alias("root"), F.when(empty, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def _as_longs(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2)
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
            data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64) if len(raw) else np.zeros(0, np.int64)
            grams = pa.ListArray.from_arrays(pa.array(((ends - ends[0]) // 8).astype(np.int32)), pa.array(data.copy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], ["doc", "n", "grams"])

    return sets.select("doc", "n", "grams").mapInArrow(run, "doc long, n long, grams array<long>")


def _with_prints(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs with _one and _two, which stand for each row's set."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_print(own) for own in _sets(batch.column(place), width)]
            columns = [pa.array([x[k] for x in prints], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_one", "_two"])
            release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_one", T.LongType()), T.StructField("_two", T.LongType())]))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, sizes: Sizes | None = None) -> DataFrame:
    """The rows of docs with one document of each class left, that of the smallest key; rows without key stay.

    A row of a key that occurs more than once is judged by its own text, and goes only if another row stands for its class.
    """
    found = storage.materialize(_judged(docs, key, text, width, percent, sizes or Sizes()), "classes")
    again = storage.materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "repeated-keys")
    n = again.count()
    own = F.col(key).cast("long")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    once = docs.join(_small(again, n), own == F.col("_again"), "left_anti") if n else docs
    left = once.join(gone, own == F.col("_gone"), "left_anti")
    if not n:
        return left
    firsts = found.where("doc_id = component_id").join(_small(again, n), F.col("doc_id") == F.col("_again"), "left_semi")
    firsts = firsts.select(F.col("doc_id").alias("_id"), F.col("one").alias("_one"), F.col("two").alias("_two"), F.col("root").alias("_root")).distinct()
    repeated = _with_prints(docs.join(_small(again, n), own == F.col("_again"), "left_semi"), text, width)
    kept = repeated.withColumn("_id", own).join(firsts, ["_id", "_one", "_two"]).dropDuplicates(["_id", "_root"])
    return left.unionByName(kept.select(*docs.columns))
