"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a pseudo-random number u in (0, 1); the key goes to the shard
with the largest weight / -ln(u).  A shard that is added takes keys only into itself, and
a shard whose weight changes moves only the keys that it wins or loses.

Defined results: a null key hashes as the empty string; a null text has no bytes (size 1,
crc32 0); repeated rows keep one slot each; an empty table gives an empty table; columns of
the input named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are dealt first by one of so many buckets of the key, so that no window holds a whole shard.
SLOT_BUCKETS = 1024


def _unit(key: Column, shard: int) -> Column:
    head = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)


def _draws(key: Column, weights: Sequence[float]) -> Column:
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive")
    return F.array(*[F.struct((F.lit(float(w)) / -F.log(_unit(key, k))).alias("draw"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)])


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key; the smaller one at a tie."""
    return (-F.array_max(_draws(F.coalesce(key.cast("string"), F.lit("")), weights))["shard"]).cast("int")


def with_slots(df: DataFrame, key: str, shard: str = "shard", slot: str = "slot", ties: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each shard without gaps from 0, in ascending (bucket of the key, key, ties) order.

    Rows of one key need columns that tell them apart as `ties`, so that a task that runs again
    numbers them as before; rows that are equal in these too may change places.

    Rows are numbered inside (shard, bucket) windows and moved on by the rows of the buckets
    before, of which there are SLOT_BUCKETS a shard at most.
    """
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    dealt = df.withColumn("_bucket", (F.conv(F.substring(F.md5(text_key), 1, 4), 16, 10).cast("int") % SLOT_BUCKETS))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(shard, "_bucket").count().select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(F.col(key).asc_nulls_first(), *ties)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    # a row for each shard and bucket: bounded by the number of shards, not by the data
    return ranked.join(F.broadcast(starts), [shard, "_bucket"]).withColumn(slot, (F.col("_start") + F.col("_rank")).cast("long")).drop("_bucket", "_start", "_rank")


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown: float | None = 1.0) -> DataFrame:
    """Add size, text_crc32, law, shard and, with `grown`, the shard after one more of that weight (grown_shard)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = {"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(F.encode(body, "UTF-8")), "law": F.lit("key"), "shard": rendezvous(F.col(key), weights)}
    if grown is not None:
        out["grown_shard"] = rendezvous(F.col(key), [*weights, grown])
    return df.withColumns(out)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, parts: int = 1) -> None:
    """Write whole rows to path/shard=K/, each shard as `parts` files at most for each of its slices, in key order."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    dealt = df.withColumn("shard", rendezvous(F.col(key), weights)).withColumn("_part", slot)
    dealt.repartition(len(weights) * parts, "shard", "_part").drop("_part").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)
