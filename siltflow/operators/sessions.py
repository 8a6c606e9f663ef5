"""Queries over what runs wrote: log, journal, trace, provenance, snapshot comparison."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.operators.scratch import hold


def log(entries: DataFrame, errors: DataFrame | None = None, stage: str | None = None, only: str | None = None, search: str | None = None, regex: bool = False, tail: int = 50) -> DataFrame:
    """The last `tail` records by t of a session's log (t, sid, level, msg) and errors (t, sid, error, input).

    only: "log" or "error".  search looks in msg, error and input without regard to case.
    """
    parts = []
    if only != "error":
        parts.append(entries.withColumn("kind", F.lit("log")))
    if errors is not None and only != "log":
        parts.append(errors.withColumn("kind", F.lit("error")))
    if not parts:
        parts = [entries.where(F.lit(False)).withColumn("kind", F.lit("log"))]
    df = parts[0]
    for x in parts[1:]:
        df = df.unionByName(x, allowMissingColumns=True)
    return _matching(df, stage, search, regex).orderBy(F.desc("t")).limit(tail).orderBy("t")


def _matching(df: DataFrame, stage: str | None, search: str | None, regex: bool) -> DataFrame:
    if stage is not None:
        df = df.where(F.col("sid") == stage)
    if search is not None:
        pattern = "(?i)" + (search if regex else re.escape(search))
        test = F.lit(False)
        for name in ("msg", "error", "input"):
            if name in df.columns:
                test = test | F.coalesce(F.col(name).rlike(pattern), F.lit(False))
        df = df.where(test)
    return df


def follow(spark: SparkSession, folder: str, stage: str | None = None, search: str | None = None, regex: bool = False) -> DataFrame:
    """A stream of the matching log records (t, sid, level, msg) of a session's log table: those there, and those that come."""
    return _matching(spark.readStream.schema("t long, sid string, level string, msg string").parquet(folder), stage, search, regex)


def journal(stages: Sequence[str], trace: DataFrame, errors: DataFrame) -> DataFrame:
    """sid, rows_out, errors, state of each stage, from trace and error records; stages without any have zeros."""
    spark = trace.sparkSession
    known = spark.createDataFrame([(x,) for x in stages], "sid string")
    out = trace.groupBy("sid").agg(F.count("*").alias("rows_out"))
    bad = errors.groupBy("sid").agg(F.count("*").alias("errors"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return known.join(out, "sid", "full").join(bad, "sid", "full").select("sid", zero("rows_out"), zero("errors"), F.lit("killed").alias("state"))


def journal_totals(stages: DataFrame) -> DataFrame:
    """envelopes_observed, stages_ok, stages_failed of a journal."""
    return stages.agg(F.sum("rows_out").alias("envelopes_observed"), F.count_if(F.col("errors") == 0).alias("stages_ok"), F.count_if(F.col("errors") > 0).alias("stages_failed"))


def traced(df: DataFrame, sid: str, labels: Mapping[str, Column] | None = None, most: int = 10, chars: int = 1000) -> DataFrame:
    """A trace record for each row: id, src, sid and labels, of which there are `most`, each `chars` long, at most."""
    pairs = [x for k, v in list((labels or {}).items())[:most] for x in (F.lit(k), F.substring(v.cast("string"), 1, chars))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    own = lambda x: (F.col(x) if x in df.columns else F.lit(None).cast("string")).alias(x[1:])
    return df.select(own("_id"), own("_src"), F.lit(sid).alias("sid"), made.alias("labels"))


def provenance(trace: DataFrame, ids: DataFrame, most_steps: int = 50) -> DataFrame:
    """id, step, at: the records that each id comes from, by following id to src; step is the shortest way.

    One join a step, each held in the shared folder, until a step finds no record that the id
    hasn't met; so circles end.  A way of more than `most_steps` is an error.
    """
    edges = trace.where("id <> src").select(F.col("id").alias("at"), F.col("src").alias("next")).distinct()
    met = now = hold(ids.select("id", F.col("id").alias("at"), F.lit(0).alias("step")).distinct(), "ids")
    for step in range(1, most_steps + 2):
        further = now.join(edges, "at").select("id", F.col("next").alias("at"), F.lit(step).alias("step")).distinct()
        now = hold(further.join(met, ["id", "at"], "left_anti").select("id", "at", "step"), "ancestors")
        if now.isEmpty():
            return met
        met = met.unionByName(now)
    raise RuntimeError(f"a way of more than {most_steps} steps")


# ---- snapshots

# Tests that a place of a snapshot may name instead of a value.
MATCHERS = {
    "is_int": lambda c: c.rlike(r"^-?\d+$"),
    "is_float": lambda c: c.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"),
    "is_string": lambda c: c.isNotNull(),
    "is_uuid": lambda c: c.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
    "is_iso8601": lambda c: c.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"),
}


def canonical(df: DataFrame, drop: Sequence[str] = (), matchers: Mapping[str, str | tuple] | None = None, scrub: Sequence[tuple[str, str]] = ()) -> Column:
    """A record as JSON text with sorted columns, without id and src, with matched places as sentinels and patterns replaced."""
    fields = []
    for name in sorted(x for x in df.columns if x not in ("_id", "_src", "id", "src", *drop)):
        col = F.col(f"`{name}`")
        spec = (matchers or {}).get(name)
        if spec is not None:
            kind = spec if isinstance(spec, str) else spec[0]
            text = col.cast("string")
            if kind == "regex":
                good = text.rlike(spec[1])
            elif kind == "in_range":
                good = text.try_cast("double").between(spec[1], spec[2])
            else:
                good = MATCHERS[kind](text)
            col = F.when(good, F.lit(f"<{kind}>")).otherwise(text)
        elif isinstance(df.schema[name].dataType, T.StringType):
            for pattern, with_ in scrub:
                col = F.regexp_replace(col, pattern, with_)
        fields.append(col.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def compare(expected: DataFrame, actual: DataFrame, **how) -> DataFrame:
    """side, record, n: records that one side has more often than the other; nothing if they are equal as multisets."""
    one = lambda df, n: df.select(canonical(df, **how).alias("record"), F.lit(n).alias("n"))
    sums = one(expected, -1).union(one(actual, 1)).groupBy("record").agg(F.sum("n").alias("n")).where("n <> 0")
    return sums.select(F.when(F.col("n") < 0, "missing").otherwise("unexpected").alias("side"), "record", F.abs("n").alias("n"))


def channel_shape(declared: Sequence[str], counts: Mapping[str, int]) -> list[str]:
    """What is wrong: declared channels without expectation, and undeclared ones with records."""
    return [f"{x}: declared but nothing expected" for x in declared if x not in counts] + [f"{x}: {n} records but not declared" for x, n in counts.items() if n and x not in declared]


def tree_diff(expected: Mapping[str, bytes], actual: Mapping[str, bytes], mode: str = "exact", least: float = 0.9) -> dict[str, list[str]]:
    """Missing, unexpected and differing paths of two file trees.  mode: exact, exists, contains, or fuzzy (a share of equal lines)."""
    import difflib

    def equal(a: bytes, b: bytes) -> bool:
        if mode == "exists":
            return True
        if mode == "contains":
            return a in b
        if mode == "fuzzy":
            return difflib.SequenceMatcher(None, a.splitlines(), b.splitlines()).ratio() >= least
        return a == b

    return {"missing": sorted(set(expected) - set(actual)), "unexpected": sorted(set(actual) - set(expected)), "different": sorted(k for k in set(expected) & set(actual) if not equal(expected[k], actual[k]))}
