"""Folds by the crc32 of a key's text, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % folds).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, label of the labelled rows outside the held-out fold: the `most` first in the order of a hash of the key.

    A key that is labelled twice counts once, with its larger label; null keys and labels are left out.
    """
    own = labels.where(F.col(key).isNotNull() & F.col(target).isNotNull() & (remainder(key, folds) != held_out))
    own = own.groupBy(F.col(key).alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("label"))
    first = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # `most` rows of two numbers: bounded by the parameter
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(first), "doc_id")
