"""Words and shingles of texts as Column expressions.

Arrays that a lambda looks into are columns of a projection of their own, which Spark keeps
apart when it is used more than once; else it would build them again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, between which words stand.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null, empty and blank texts."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))


def with_shingles(df: DataFrame, words_col: str, widths: tuple[int, ...], out: str, hashes: str = "_h") -> DataFrame:
    """Add the 64-bit hash of each run of `width` words, for each width that is asked for."""
    hashed = df.withColumn(hashes, F.transform(words_col, lambda w: F.xxhash64(w)))

    def runs(width: int) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - width)
        held = F.transform(places, lambda i: F.xxhash64(F.lit(width), *[F.get(F.col(hashes), i + k) for k in range(width)]))
        return F.when(F.size(hashes) >= width, held).otherwise(F.array().cast("array<bigint>"))

    parts = [runs(x) for x in widths]
    return hashed.withColumn(out, parts[0] if len(parts) == 1 else F.concat(*parts))
