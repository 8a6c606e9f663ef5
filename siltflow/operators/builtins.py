"""In-stream operators: filter, route, dedup, group_by, spread, toggle, fan_in, replicas, gate, checkpoint.

A record is a row; where an operator needs arrival order, `order` names the columns that give
it (default `_ord`).  Error policies are those of the stage: drop, pass or fail.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.functions.expression import compile_node, kind_of, parse, predicate, quoted, resolve


@dataclass
class Outputs:
    """What a stage gives: its data, and side outputs where it has any."""

    data: DataFrame
    meta: DataFrame | None = None
    trace: DataFrame | None = None
    errors: DataFrame | None = None


def filter_rows(df: DataFrame, expression: str, on_error: str = "drop") -> DataFrame:
    """Rows for which the expression is truthy.  Rows on which it fails go (drop), stay (pass) or end the job (fail)."""
    tree = parse(expression)
    if on_error == "drop":
        return df.where(predicate(tree, df.schema))
    found = compile_node(tree, df.schema)
    if found.fails is None:
        return df.where(predicate(tree, df.schema))
    if on_error == "pass":
        return df.where(found.fails | found.truth())
    if on_error == "fail":
        stop = F.raise_error(F.lit(f"filter failed: {expression}")).cast("boolean")
        return df.where(F.when(found.fails, stop).otherwise(found.truth()))
    raise ValueError(f"unknown on_error {on_error!r}")


def with_channel(df: DataFrame, routes: Mapping[str, str], on_error: str = "drop", column: str = "_channel") -> DataFrame:
    """Add the name of the first route whose expression is truthy, null if there is none.  A route that fails is passed over; under `fail` the row matches none."""
    case: Column | None = None
    for name, expression in routes.items():
        found = compile_node(parse(expression), df.schema)
        if on_error == "fail" and found.fails is not None:
            case = F.when(found.fails, F.lit(None).cast("string")) if case is None else case.when(found.fails, F.lit(None).cast("string"))
        test = found.truth() if found.fails is None else found.truth() & ~found.fails
        case = F.when(test, name) if case is None else case.when(test, name)
    return df.withColumn(column, case if case is not None else F.lit(None).cast("string"))


def route(df: DataFrame, routes: Mapping[str, str], on_error: str = "drop") -> dict[str, DataFrame]:
    """The rows of each channel; unmatched rows are dropped."""
    marked = with_channel(df, routes, on_error)
    return {x: marked.where(F.col("_channel") == x).drop("_channel") for x in routes}


def key_text(df: DataFrame, paths: Sequence[str]) -> Column:
    """The text that stands for a row's key: null and missing as "", nested values as JSON, parts joined by a bar; all columns as JSON if no path is given."""
    if not paths:
        return F.to_json(F.struct(*[F.col(quoted(x)) for x in sorted(df.columns) if not x.startswith("_")]))
    return F.concat_ws("|", *[segment(df.schema, x) for x in paths])


def segment(schema: T.StructType, path: str) -> Column:
    found = resolve(tuple(re.sub(r"^(v|env)\.", "", path).split(".")), schema)
    if found is None:
        return F.lit("")
    col, kind = found
    if kind_of(kind) in ("array", "object", "map"):
        col = F.to_json(col)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        col = F.when(col == F.floor(col), F.format_string("%d", col.cast("long"))).otherwise(col.cast("string"))
    return F.coalesce(col.cast("string"), F.lit(""))


def dedup(df: DataFrame, key: Sequence[str], order: Sequence[str] = ("_ord",), on_duplicate: str = "drop", index: str | None = None, load_existing: bool = True, label: str = "dedup") -> Outputs:
    """The first row of each key in the given order.

    `index` names a Parquet table of keys seen by earlier runs: rows with one of these go, and
    new keys are appended.  on_duplicate: drop; trace, meta or error list the rows that went.
    One aggregation by key with map-side partial results; duplicates are listed by a window
    only when asked for.
    """
    keyed = df.withColumn("_key", key_text(df, key))
    spark = df.sparkSession
    fresh = keyed
    if index and load_existing and _exists(spark, index):
        seen = spark.read.schema("_key string").parquet(index)
        fresh = keyed.join(seen, "_key", "left_anti")
    place = F.struct(*[F.col(quoted(x)) for x in order])
    if on_duplicate == "drop":
        packed = F.struct(*[F.col(quoted(x)) for x in df.columns])
        first = fresh.groupBy("_key").agg(F.min_by(packed, place).alias("_row"))
        kept, gone = first.select("_row.*", "_key"), None
    else:
        ranked = fresh.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*[F.col(quoted(x)) for x in order])))
        kept, gone = ranked.where("_rank = 1").drop("_rank"), ranked.where("_rank > 1").drop("_rank")
        if fresh is not keyed:
            gone = gone.unionByName(keyed.join(seen, "_key", "left_semi"))
    if index:
        # the plan of `kept` reads the index lazily, so it is held before its keys are added
        kept = checkpoint(kept, f"{index.rstrip('/')}-rows")
        kept.select("_key").write.mode("append").parquet(index)
    out = Outputs(kept.drop("_key").select(*df.columns))
    if gone is not None:
        named = gone.select(F.lit(label).alias("dedup"), F.col("_key").alias("k"), *[F.col(x) for x in ("_id", "_src") if x in df.columns])
        if on_duplicate == "trace":
            out.trace = named
        elif on_duplicate == "meta":
            out.meta = named.withColumn("kind", F.lit("dedup_drop")).drop("dedup")
        elif on_duplicate == "error":
            out.errors = named.withColumn("error", F.concat(F.lit("duplicate key "), F.col("k")))
        else:
            raise ValueError(f"unknown on_duplicate {on_duplicate!r}")
    return out


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def group_by(df: DataFrame, key: Sequence[str] | str, label: str, value: str, expected: Sequence[str] | None = None, count_threshold: int | None = None, emit_partial: bool = False, order: Sequence[str] = ("_ord",)) -> DataFrame:
    """Collect label -> value of each key, last write wins, and emit a group when all expected labels are there, or else when it has count_threshold labels; a key then begins anew.

    Output: _group_key, _seq (which emission of its key), _partial, and labels (a map of label to
    value).  With emit_partial, what is left at the end follows as partial.  Expected labels win
    over the threshold.  Emissions depend on all rows of a key before them, so a key is folded in
    order by one task, which streams its sorted rows and holds one group at a time.  Without labels
    or a threshold only the end counts: that is an aggregation, combined before the shuffle.
    """
    paths = [key] if isinstance(key, str) else list(key)
    val = resolve(tuple(value.removeprefix("v.").split(".")), df.schema)
    if val is None:
        raise ValueError(f"no column for {value!r}")
    wanted = list(dict.fromkeys(expected or []))
    places = [f"_o{k}" for k in range(len(order))]
    rows = df.select(key_text(df, paths).alias("_group_key"), *[F.col(quoted(x)).alias(o) for x, o in zip(order, places, strict=True)], segment(df.schema, label).alias("l"), val[0].alias("x"))
    if not wanted and not count_threshold:
        place = F.struct(*places)
        last = rows.groupBy("_group_key", "l").agg(F.max(place).alias("o"), F.max_by("x", place).alias("x"))
        pairs = F.transform(F.sort_array(F.collect_list(F.struct("o", "l", "x"))), lambda p: F.struct(p["l"], p["x"]))
        ends = last.groupBy("_group_key").agg(F.map_from_entries(pairs).alias("labels"))
        return ends.where(F.lit(emit_partial)).select("_group_key", F.lit(0).alias("_seq"), F.lit(True).alias("_partial"), "labels")
    ties = ["l", "x"] if isinstance(val[1], T.AtomicType) else ["l"]
    dealt = rows.repartition("_group_key").sortWithinPartitions("_group_key", *places, *ties).select("_group_key", "l", "x")
    schema = T.StructType([T.StructField("_group_key", T.StringType()), T.StructField("_seq", T.IntegerType()), T.StructField("_partial", T.BooleanType()), T.StructField("labels", T.MapType(T.StringType(), val[1]))])
    return dealt.mapInArrow(_folder(set(wanted), count_threshold, emit_partial), schema)


def _folder(wanted: set[str], count_threshold: int | None, emit_partial: bool, most: int = 10_000):
    """Rows (key, label, value), sorted, to groups; `most` of them in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, bool, list[tuple[str, Any]]]] = []
        key, seq, now, kind = None, 0, {}, None

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            types = (pa.string(), pa.int32(), pa.bool_(), pa.map_(pa.string(), kind))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["_group_key", "_seq", "_partial", "labels"])

        def ended() -> None:
            if emit_partial and now:
                out.append((key, seq, True, list(now.items())))

        for batch in batches:
            kind = batch.column(2).type
            for k, label, x in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                if k != key:
                    ended()
                    key, seq, now = k, 0, {}
                now.pop(label, None)  # the last write of a label is the last in order
                now[label] = x
                if (wanted <= now.keys()) if wanted else (len(now) >= count_threshold):
                    out.append((key, seq, False, list(now.items())))
                    seq, now = seq + 1, {}
                if len(out) >= most:
                    yield made()
                    out.clear()
        ended()
        if out:
            yield made()

    return run


def group_by_unique(df: DataFrame, key: Sequence[str] | str, label: str, value: str, expected: Sequence[str]) -> DataFrame:
    """group_by for data with one row at most for each key and label: an aggregation without collected rows.  A column for each expected label; only full groups."""
    paths = [key] if isinstance(key, str) else list(key)
    val = resolve(tuple(value.removeprefix("v.").split(".")), df.schema)[0]
    tag = segment(df.schema, label)
    columns = [F.max(F.when(tag == x, val)).alias(x) for x in expected]
    marks = [F.max(tag == x) for x in expected]
    full = marks[0]
    for x in marks[1:]:
        full = full & x
    return df.groupBy(key_text(df, paths).alias("_group_key")).agg(*columns, full.alias("_full")).where("_full").drop("_full")


def spread(df: DataFrame, consumers: int) -> list[DataFrame]:
    """The same rows for each consumer; there has to be one."""
    if consumers < 1:
        raise ValueError("spread has no consumer")
    return [df] * consumers


def toggle(df: DataFrame, env: str | None = None, value: str | None = None, values: Sequence[str] | None = None, mode: str = "on", environ: Mapping[str, str] | None = None) -> DataFrame:
    """All rows or none, decided when the plan is made by an environment variable: on passes at a match, off at none; without value or values a match is a non-empty variable."""
    if env is None:
        return df
    now = (os.environ if environ is None else environ).get(env, "")
    wanted = [value] if value is not None else list(values or [])
    match = now in wanted if wanted else now != ""
    return df if match == (mode == "on") else df.where(F.lit(False))


def fan_in(inputs: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs, repeated ones too.  Order is (place of the input, _ord): both columns exist if the inputs have _ord."""
    if not inputs:
        raise ValueError("fan_in has no input")
    marked = [x.withColumn("_input", F.lit(k)) if "_ord" in x.columns and len(inputs) > 1 else x for k, x in enumerate(inputs)]
    out = marked[0]
    for x in marked[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def replicas(df: DataFrame, n: int, routing: str = "round-robin") -> DataFrame:
    """Rows of one _id in one of n partitions, for routing "hash-id".  Round-robin and least-busy move nothing: Spark already runs a stage in as many tasks as it has splits."""
    return df.repartition(n, "_id") if routing == "hash-id" else df


def observed(x: Observation) -> bool:
    """Whether an action that has ended has passed the rows of an observation; its metrics come a moment later than its end."""
    if x._jo is None:
        return False
    SparkContext._active_spark_context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return bool(x._jo.future().isCompleted())


class Gate:
    """Rows that pass through `data` untouched and are counted on their way, by whatever action they pass first."""

    def __init__(self, df: DataFrame, name: str, path: str, stage: str = "gate", order: str = "_ord", key: str = "_id"):
        self.name, self.path, self.stage = name, path, stage
        last = F.max_by(F.col(key).cast("string"), F.col(order)) if key in df.columns and order in df.columns else F.max(F.lit(None).cast("string"))
        self.seen = Observation(f"gate-{name}-{time.time_ns()}")
        self.data = df.observe(self.seen, F.count(F.lit(1)).alias("count"), last.alias("last_id"))

    def settle(self) -> None:
        """Write the state (name, count, last_id, updated_at, predicate_met, stage_id) to path as JSON; rows that no action has passed are run through here.

        At the end of input the predicate is met whatever the count: expect_count only lets
        followers begin early.
        """
        if not observed(self.seen):
            self.data.write.format("noop").mode("overwrite").save()
        got = self.seen.get
        row = (self.name, got["count"], got["last_id"], int(time.time() * 1000), True, self.stage)
        schema = "name string, count long, last_id string, updated_at long, predicate_met boolean, stage_id string"
        self.data.sparkSession.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(self.path)


def gate(df: DataFrame, name: str, path: str, expect_count: int | None = None, stage: str = "gate", order: str = "_ord", key: str = "_id") -> DataFrame:
    """Pass rows on, after their count has been written; a Gate counts them on their way instead."""
    own = Gate(df, name, path, stage, order, key)
    own.settle()
    return df


def checkpoint(df: DataFrame, folder: str, gates: Sequence[str] = (), settle: Sequence[Gate] = ()) -> DataFrame:
    """Hold all rows until the input has ended and all gates are met: written to a new folder under `folder` and read back.

    Gates of `settle` write their state when the rows have been written, which as a rule has passed them.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/spool-{time.time_ns()}"
    df.write.parquet(path)
    for x in settle:
        x.settle()
    for at in gates:
        met = spark.read.json(at).agg(F.bool_and("predicate_met").alias("met")).first()["met"]
        if not met:
            raise RuntimeError(f"gate {at} isn't met")
    return spark.read.schema(df.schema).parquet(path)
