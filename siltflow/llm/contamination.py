"""Benchmark decontamination, in DataFrame functions only.

An item is found in a document that holds at least `threshold` of the item's distinct
shingles (five lower-cased words; the whole item where it has fewer).  Search by MinHash
containment: items are partitioned by size (shingle counts up to 5, 10, 15, ...), and each
item is kept as its bottom-k MinHash sketch, the k smallest of its shingles' hashes, where
k = u - ceil(threshold * u) + 1 for the partition's upper size u.  A document that holds
threshold * n of an item's n shingles cannot miss all of those k, so a document that holds
none of a sketch is ruled out, however long it is, and no true pair is lost.  (Sketches of
whole long documents, as in an LSH ensemble, would have to be estimated against a Jaccard
similarity near zero; probing them with the items' sketches is exact.)  Candidates
are verified by counting the item's shingles in the document.

The sketches are broadcast when their rows, which are counted first, are within
BROADCAST_ROWS; beyond that Spark joins by hash.  The same holds for candidate keys.

Defined results: null and empty texts and items have no shingles and match nothing; in find(),
as in its SQL, rows of one key count as one document, and null keys are one key; remove() judges
each row by its own text; repeated items are found each by its
id; columns other than key and text don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.llm.native_text import with_shingles, words

WIDTH = 5
SIZE_STEP = 5
BROADCAST_ROWS = 1_000_000


def _words(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), words(F.lower(F.col(text))).alias("_words"))


def item_shingles(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, shingle, width, n (the item's distinct shingles)."""
    split = _words(items, key, text, "item_id").where(F.col("item_id").isNotNull()).withColumn("width", F.least(F.lit(WIDTH), F.size("_words")))
    parts = [with_shingles(split.where(F.col("width") == w), "_words", (w,), "_s").select("item_id", "width", F.explode_outer("_s").alias("shingle")) for w in range(1, WIDTH + 1)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    rows = rows.where(F.col("shingle").isNotNull()).distinct()
    return rows.join(rows.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """item_id, shingle: the bottom-k MinHash sketch of each item, k by its size partition."""
    from pyspark.sql import Window

    upper = F.ceil(F.col("n") / SIZE_STEP) * SIZE_STEP
    k = upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1
    order = Window.partitionBy("item_id").orderBy("_hash", "shingle")
    ranked = shingles.withColumn("_hash", F.xxhash64("shingle", F.lit(1))).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= k).select("item_id", "shingle")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Pairs doc_id, item_id, n_item, n_shared, containment of all documents and the items in them."""
    from siltflow.llm import storage

    shingles = storage.materialize(item_shingles(items, item_key, item_text), "item-shingles")
    sizes = shingles.groupBy("width").agg(F.count("*").alias("n")).collect()  # WIDTH rows at most
    widths = tuple(sorted(x["width"] for x in sizes)) or (WIDTH,)
    total = sum(x["n"] for x in sizes)
    sketch = sketches(shingles, threshold)

    def exploded(rows: DataFrame) -> DataFrame:
        held = with_shingles(rows, "_words", widths, "_s")
        # not explode(): the filter on its array that Spark would infer builds that array again for each element
        return held.select("_key", F.explode_outer("_s").alias("shingle"))

    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("\x00")).alias("_key"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    split = source.select("_key", words(F.lower(F.col("text"))).alias("_words"))
    probed = exploded(split).join(_small(sketch, total), "shingle").select("_key", "item_id").distinct()
    candidates = storage.materialize(probed, "contamination-candidates")
    keys = storage.materialize(candidates.select("_key").distinct(), "contamination-keys")
    near = source.join(_small(keys, keys.count()), "_key", "left_semi")
    again = near.select("_key", words(F.lower(F.col("text"))).alias("_words"))
    # every shingle of a candidate's items, once for each document
    matched = exploded(again).join(_small(shingles, total), "shingle").groupBy("_key", "item_id", "n").agg(F.count_distinct("shingle").alias("n_shared"))
    found = matched.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).join(candidates, ["_key", "item_id"], "left_semi")
    number = docs.schema[key].dataType
    return found.select(F.when(F.col("_key") == "\x00", None).otherwise(F.col("_key")).cast(number).alias("doc_id"), "item_id", F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose own text holds no item; a row's key doesn't matter, so rows without key or of one key don't fall together."""
    from siltflow.llm import storage

    own = F.md5(F.coalesce(F.col(text), F.lit("")))
    found = find(docs.select(own.alias("_row"), F.col(text).alias("_text")), items, "_row", "_text", item_key, item_text, threshold)
    bad = storage.materialize(found.select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(_small(bad, bad.count()), own == F.col("_bad"), "left_anti")
