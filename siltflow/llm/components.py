"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.llm import storage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for each node of edges (a, b) that isn't the least of its component, which is the root.

    Every round is two aggregations and joins by node, is written to the shared folder, and
    hangs each node on a smaller one; rounds end when none moves.  A node with very many
    neighbours is a hot join key that adaptive execution splits.
    """
    now = storage.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v's neighbours u
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.where("v > u")
        least = low.groupBy("v").agg(F.min("u").alias("m"))
        small = low.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(least.select("v", F.col("m").alias("u")))
        now = storage.materialize(small.distinct(), "edges")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("h")).first()
        if state == (new["n"], new["h"]):
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = (new["n"], new["h"])
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
