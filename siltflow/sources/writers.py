"""Sinks: text files chosen by a record's `file`, with or without dedup by content, and terminal drains.

A target path is a folder of part files that Spark commits as a whole.  Rows of one target
are in order within its parts.  Rows meet by target, and adaptive execution splits a large target
among tasks, so that one target may hold all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.functions.expression import quoted
from siltflow.operators.builtins import _exists


def line_of(df: DataFrame, kind: str, csv_columns: Sequence[str] = ()) -> Column:
    """A record as a line: its `row` if it has one, else all its columns but `file`."""
    own = [x for x in df.columns if not x.startswith("_") and x != "file"]
    row = "row" in df.columns
    payload = F.col("row") if row else F.struct(*[F.col(quoted(x)) for x in own])
    dtype = df.schema["row"].dataType if row else None
    plain = row and not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
    if kind == "ndjson":
        return F.to_json(payload, {"ignoreNullFields": "false"}) if not plain else F.col("row").cast("string")
    if kind == "lines":
        return F.col("row").cast("string") if plain else F.to_json(payload, {"ignoreNullFields": "false"})
    if kind == "csv":
        if not csv_columns:
            raise ValueError("csv needs csv_columns")
        cell = lambda x: (F.col("row").getField(x) if row else F.col(quoted(x))).cast("string")
        quote = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
        return F.concat_ws(",", *[quote(cell(x)) for x in csv_columns])
    raise ValueError(f"unknown format {kind!r}")


def _targets(df: DataFrame, default_file: str | None) -> Column:
    return F.coalesce(F.col("file"), F.lit(default_file)) if "file" in df.columns else F.lit(default_file)


def write_stream(df: DataFrame, base: str, kind: str = "ndjson", default_file: str | None = "out", write_mode: str = "append", csv_columns: Sequence[str] = (), order: str = "_ord", pass_through: bool = False) -> DataFrame | None:
    """Write each record to base/file=<name>; truncate replaces the targets that get records."""
    spark = df.sparkSession
    if write_mode not in ("append", "truncate"):
        write_mode = "append"  # an unknown mode appends
    keep = [F.col(order)] if order in df.columns else []
    lines = df.select(_targets(df, default_file).alias("file"), line_of(df, kind, csv_columns).alias("value"), *[c.alias("_ord") for c in keep])
    dealt = _dealt(lines, bool(keep))
    writer = dealt.write.partitionBy("file").mode("append" if write_mode == "append" else "overwrite")
    if write_mode == "truncate":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.text(base)
    return df if pass_through else None


def _dealt(lines: DataFrame, ordered: bool) -> DataFrame:
    return lines.hint("rebalance", "file").sortWithinPartitions("file", *(["_ord"] if ordered else [])).drop("_ord")


def target_lines(spark: SparkSession, base: str) -> DataFrame:
    """file, value of all lines written under base."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/file=*")
    targets = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not targets:
        return spark.createDataFrame([], "value string, file string")
    return spark.read.schema("value string, file string").option("basePath", base).text(base)


def _size(spark: SparkSession, base: str) -> int:
    """Bytes of all files under base, as the file system knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def write_hashed(df: DataFrame, base: str, kind: str = "ndjson", default_file: str | None = "out", hash_field: str | None = None, order: str = "_ord", csv_columns: Sequence[str] = (), sidecar: bool = True) -> DataFrame:
    """write_stream without records that their target already holds, nor repeated ones.  Gives the rejected rows.

    Records are told apart by their line, or by row[hash_field] (a row without it is rejected).
    Keys seen are kept in <base>_keys, a table beside the output, with the output's size after
    each run.  Where it is missing, or the output has another size than it was left with, keys are
    taken from the lines that are there and the table is made anew; without `sidecar` they always
    are, and no table is kept.
    """
    spark = df.sparkSession
    line = line_of(df, kind, csv_columns)
    field = None if hash_field is None else (F.col("row").getField(hash_field) if "row" in df.columns else F.col(quoted(hash_field))).cast("string")
    marked = df.withColumns({"_file": _targets(df, default_file), "_line_text": line, "_k": line if field is None else field})
    bad = marked.where(F.col("_k").isNull()).drop("_file", "_line_text", "_k").withColumn("_error", F.lit(f"no field {hash_field}"))
    at = f"{base.rstrip('/')}_keys"
    held = target_lines(spark, base)
    known = spark.read.schema("file string, k string, bytes long").parquet(at) if sidecar and _exists(spark, at) else None
    # files only ever grow, so the last run's size is the largest
    rebuilt = known is None or (known.agg(F.max("bytes").alias("n")).first()["n"] or 0) != _size(spark, base)
    if not rebuilt:
        seen = known.where("bytes IS NULL").select("file", "k")
    else:
        seen = held.select("file", (F.col("value") if hash_field is None else F.get_json_object("value", f"$.{hash_field}")).alias("k"))
    fresh = marked.where(F.col("_k").isNotNull()).join(seen.select(F.col("file").alias("_file"), F.col("k").alias("_k")), ["_file", "_k"], "left_anti")
    place = F.col(order) if order in df.columns else F.monotonically_increasing_id()
    first = fresh.groupBy("_file", "_k").agg(F.min_by(F.struct(F.col("_line_text").alias("value"), place.alias("_ord")), place).alias("x"))
    from siltflow.operators.builtins import checkpoint

    new = checkpoint(first.select(F.col("_file").alias("file"), F.col("_k").alias("k"), "x.value", "x._ord"), f"{base.rstrip('/')}_new")
    _dealt(new.select("file", "value", "_ord"), True).write.partitionBy("file").mode("append").text(base)
    if sidecar:
        keys = new.select("file", "k")
        if rebuilt:  # of the lines as they were, and with them
            keys = keys.union(seen.select("file", "k"))
        keys.withColumn("bytes", F.lit(None).cast("long")).write.mode("overwrite" if rebuilt else "append").parquet(at)
        spark.createDataFrame([(None, None, _size(spark, base))], "file string, k string, bytes long").write.mode("append").parquet(at)
    return bad


def drain(df: DataFrame, sink: str = "discard", path: str | None = None):
    """Terminal drains: discard (runs nothing), memory (rows on the driver; for tests), debug (JSON under path)."""
    if sink == "discard":
        return None
    if sink == "memory":
        return df.collect()
    if sink == "debug":
        df.write.mode("overwrite").json(path)
        return path
    raise ValueError(f"unknown sink {sink!r}")
