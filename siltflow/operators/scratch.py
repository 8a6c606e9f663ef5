"""Tables that a plan holds on its way, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset (local tests), a folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="siltflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siltflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def hold(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df and read it back: its plan runs once, and lost executors lose nothing.  `by` makes a folder for each of a column's few values, which filters on it prune."""
    at = path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
