"""Operators on raw JSON records whose shape drifts: exact, record by record, in Arrow batches.

Typed columns cannot tell a missing property from null, nor hold values of several kinds; here
each record is parsed and the expression evaluated as it stands.  Use the typed operators
where a schema is known: they stay in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.functions.expression import EvaluationError, as_json, evaluate, parse, truthy


def _scope(text: str | None, id_: str | None, src: str | None) -> dict[str, Any]:
    v = json.loads(text)
    return {"v": v, "env": {"t": "d", "id": id_, "src": src, "v": v}}


def _columns(df: DataFrame, v: str) -> list:
    return [F.col(v).cast("string"), *[F.col(x).cast("string") if x in df.columns else F.lit(None).cast("string") for x in ("_id", "_src")]]


def filter_records(df: DataFrame, expression: str, on_error: str = "drop", v: str = "v") -> DataFrame:
    """Rows whose record makes the expression truthy.  Records that aren't JSON are dropped (or end the job under fail)."""
    tree = parse(expression)
    if on_error not in ("drop", "pass", "fail"):
        raise ValueError(f"unknown on_error {on_error!r}")

    def one(text: str | None, id_: str | None, src: str | None) -> bool:
        try:
            scope = _scope(text, id_, src)
        except (TypeError, ValueError):
            if on_error == "fail":
                raise
            return False
        try:
            return truthy(evaluate(tree, scope))
        except EvaluationError:
            if on_error == "fail":
                raise
            return on_error == "pass"

    def run(texts: pa.Array, ids: pa.Array, srcs: pa.Array) -> pa.Array:
        return pa.array([one(*x) for x in zip(texts.to_pylist(), ids.to_pylist(), srcs.to_pylist(), strict=True)], pa.bool_())

    return df.where(F.arrow_udf(run, "boolean")(*_columns(df, v)))


def channel_of_records(df: DataFrame, routes: Mapping[str, str], on_error: str = "drop", v: str = "v", column: str = "_channel") -> DataFrame:
    """Add the first route that a record makes truthy; null for none and for records that aren't JSON."""
    trees = [(k, parse(x)) for k, x in routes.items()]

    def one(text: str | None, id_: str | None, src: str | None) -> str | None:
        try:
            scope = _scope(text, id_, src)
        except (TypeError, ValueError):
            if on_error == "fail":
                raise
            return None
        for name, tree in trees:
            try:
                if truthy(evaluate(tree, scope)):
                    return name
            except EvaluationError:
                if on_error == "fail":
                    return None
        return None

    def run(texts: pa.Array, ids: pa.Array, srcs: pa.Array) -> pa.Array:
        return pa.array([one(*x) for x in zip(texts.to_pylist(), ids.to_pylist(), srcs.to_pylist(), strict=True)], pa.string())

    return df.withColumn(column, F.arrow_udf(run, "string")(*_columns(df, v)))


def with_record_key(df: DataFrame, paths: Sequence[str], v: str = "v", column: str = "_key") -> DataFrame:
    """Add the key text of a record, as dedup and group_by use it: parts joined by a bar, the canonical JSON of the whole record without paths; null if it isn't JSON."""
    parts = [x.removeprefix("v.").removeprefix("env.").split(".") for x in paths]

    def segment(value: Any) -> str:
        if value is None:
            return ""
        if isinstance(value, str):
            return value
        if isinstance(value, float) and value.is_integer():
            return str(int(value))
        return as_json(value)

    def one(text: str | None) -> str | None:
        try:
            record = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not parts:
            return as_json(record)
        out = []
        for path in parts:
            now: Any = record
            for name in path:
                now = now.get(name) if isinstance(now, dict) else None
            out.append(segment(now))
        return "|".join(out)

    return df.withColumn(column, F.arrow_udf(lambda texts: pa.array([one(x) for x in texts.to_pylist()], pa.string()), "string")(F.col(v)))


def dedup_records(df: DataFrame, paths: Sequence[str], order: Sequence[str] = ("_ord",), v: str = "v") -> DataFrame:
    """The first record of each key in order; records that aren't JSON are all passed on."""
    keyed = with_record_key(df, paths, v)
    packed = F.struct(*[F.col(x) for x in df.columns])
    first = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min_by(packed, F.struct(*[F.col(x) for x in order])).alias("_row"))
    return first.select("_row.*").unionByName(keyed.where("_key IS NULL").drop("_key"))
