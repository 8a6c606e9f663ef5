"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Paths made in each scope that is open.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (local tests), one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="siltflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siltflow/{spark.sparkContext.applicationId}"


#: Rows of a batch that passes between the JVM and Python, or comes from Parquet, unless the session asks for fewer.
BATCH_ROWS = 500


def bound_batches(spark: SparkSession) -> None:
    """Hold batches to BATCH_ROWS rows: texts of some KB make batches of some MB, on both sides."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[set[str]]:
    """Delete the tables that are made inside, but for the paths that are added to the set this gives."""
    kept: set[str] = set()
    _scopes.append([])
    try:
        yield kept
    finally:
        for path in _scopes.pop():
            if path in kept:
                if _scopes:
                    _scopes[-1].append(path)
            else:
                drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has written with new_path; DataFrames over them can't be read any more."""
    drop(spark, _own_dir(spark))


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (at `path`, or a new one) and read it back: lineage ends there, and lost executors lose nothing."""
    bound_batches(df.sparkSession)
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    bound_batches(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
