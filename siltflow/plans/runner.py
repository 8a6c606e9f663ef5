"""Variants to DataFrames: one lazy plan for each stage, actions only in sinks."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltflow.functions.expression import quoted
from siltflow.functions.normalize import normalize
from siltflow.operators import builtins as B
from siltflow.operators import sessions as S
from siltflow.plans.variant import Variant, VariantError, deep_merge, filled, inputs_of, order, prefixes_in_text, validate, with_prefixes
from siltflow.sources import readers, writers

Tool = Callable[[DataFrame, dict[str, Any]], "DataFrame | B.Outputs"]


@dataclass
class Run:
    """What a run made: `data` by stage or stage.channel, side outputs by stage, and the order of stages."""

    data: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, DataFrame] = field(default_factory=dict)
    trace: dict[str, DataFrame] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    observations: dict[str, Observation] = field(default_factory=dict)
    gates: dict[str, B.Gate] = field(default_factory=dict)

    def leaves(self, variant: Variant) -> dict[str, DataFrame]:
        used = {x for s in variant.stages.values() for x in inputs_of(s)}
        return {k: v for k, v in self.data.items() if k not in used and k.split(".")[0] not in used}

    def journal(self, wait: bool = True) -> list[dict[str, Any]]:
        """rows_out of each stage whose rows an action has passed; asks nothing of the cluster.  Without `wait`, stages that no action has passed are left out."""
        there = {k: o for k, o in self.observations.items() if wait or B.observed(o)}
        return [{"sid": k, "rows_out": o.get.get("rows_out")} for k, o in there.items()]


class Runner:
    """Compiles variants.  `tools` adds functions (df, settings) -> DataFrame or Outputs by name."""

    def __init__(self, spark: SparkSession, session_dir: str, tools: Mapping[str, Tool] | None = None, prefixes: Mapping[str, str] | None = None, environ: Mapping[str, str] | None = None):
        self.spark, self.session = spark, session_dir
        self.tools = dict(tools or {})
        self.environ = os.environ if environ is None else environ
        self.prefixes = {"session": session_dir, **(prefixes or {})}

    def compile(self, variant: Variant, source: DataFrame) -> Run:
        if errors := validate(variant, self.tools, self.environ, self.prefixes):
            raise VariantError(*errors)
        run = Run(order=order(variant.stages))
        for name in run.order:
            stage = {k: filled(v, self.environ) for k, v in variant.stages[name].items()}
            stage["settings"] = self._settings(stage)
            if stage["tool"] == "dedup" and stage.get("dedup"):
                stage["dedup"] = with_prefixes(stage["dedup"], self.prefixes)
            if isinstance(stage.get("expression"), str):
                stage["expression"] = prefixes_in_text(stage["expression"], self.prefixes)
            if stage.get("routes"):
                stage["routes"] = {k: prefixes_in_text(x, self.prefixes) for k, x in stage["routes"].items()}
            parts = [source if x == "$input" else run.data[x] for x in inputs_of(stage)]
            df = parts[0] if len(parts) == 1 else B.fan_in(parts)
            if (stage.get("replicas") or 1) > 1:
                df = B.replicas(df, stage["replicas"], stage.get("replicas_routing", "round-robin"))
            self._stage(run, name, stage, df)
        return run

    def execute(self, variant: Variant, source: DataFrame, trace: bool = True) -> Run:
        """Compile, run every leaf and leave a session: tables under session_dir that `operators.sessions` queries.

        data/<stage> has the rows of each leaf; errors (t, sid, error, input), trace (id, src, sid,
        labels; of stages whose `trace` isn't off), log (t, sid, level, msg), stages (sid, tool,
        rows_in, rows_out, errors, ms) and journal (sid, rows_out, errors, state).  Leaves run once
        and are read back from their files; stages between them are counted as they run.
        """
        began = time.time()
        events: list[tuple[int, str, str, str]] = []
        say = lambda sid, level, msg: events.append((int(time.time() * 1000), sid, level, msg))
        say("", "info", f"run of {variant.pipeline}:{variant.name} begins, {len(variant.stages)} stages")
        run = self.compile(variant, source)
        took: dict[str, int] = {}
        for name, df in run.leaves(variant).items():
            at, now = f"{self.session}/data/{name}", time.time()
            df.write.mode("overwrite").parquet(at)
            run.data[name] = self.spark.read.schema(df.schema).parquet(at)
            took[name] = int((time.time() - now) * 1000)
            say(name, "info", f"written to {at}")
        for x in run.gates.values():
            x.settle()
        errors = self._table("errors", [self._errors(sid, df) for sid, df in run.errors.items()], "t long, sid string, error string, input string")
        off = {k for k, s in variant.stages.items() if s.get("trace") is False}
        traces = [S.traced(df, sid) for sid, df in run.data.items() if trace and sid.split(".")[0] not in off]
        found = self._table("trace", traces, "id string, src string, sid string, labels map<string,string>")
        counts = {r["sid"]: r["n"] for r in errors.groupBy("sid").agg(F.count("*").alias("n")).collect()}  # a row for each stage
        seen = {x["sid"]: x["rows_out"] for x in run.journal(wait=False)}
        rows = []
        for sid in run.data | dict.fromkeys(run.order):
            stage = variant.stages[sid.split(".")[0]]
            above = [seen.get(x) for x in inputs_of(stage)]
            rows_in = sum(above) if above and None not in above else None
            rows.append((sid, stage["tool"], rows_in, seen.get(sid), counts.get(sid, 0), took.get(sid)))
            if counts.get(sid):
                say(sid, "error", f"{counts[sid]} rows rejected")
        self._table("stages", [self.spark.createDataFrame(rows, "sid string, tool string, rows_in long, rows_out long, errors long, ms long")], "")
        if trace:
            state = F.when(F.col("errors") > 0, "failed").otherwise("ok").alias("state")
            self._table("journal", [S.journal(run.order, found, errors).select("sid", "rows_out", "errors", state)], "")
        say("", "info", f"run ends after {int((time.time() - began) * 1000)} ms")
        self._table("log", [self.spark.createDataFrame(events, "t long, sid string, level string, msg string")], "")
        return run

    def _table(self, name: str, parts: list[DataFrame], schema: str) -> DataFrame:
        df = parts[0] if parts else self.spark.createDataFrame([], schema)
        for x in parts[1:]:
            df = df.unionByName(x)
        df.write.mode("overwrite").parquet(f"{self.session}/{name}")
        return self.session_table(name)

    def session_table(self, name: str) -> DataFrame:
        """A table that the last execute() has left: log, errors, trace, stages or journal."""
        return self.spark.read.parquet(f"{self.session}/{name}")

    @staticmethod
    def _errors(sid: str, df: DataFrame) -> DataFrame:
        text = next((x for x in ("_error", "error") if x in df.columns), None)
        own = F.to_json(F.struct(*[F.col(quoted(x)) for x in df.columns if x != text]), {"ignoreNullFields": "false"})
        return df.select(F.unix_millis(F.current_timestamp()).alias("t"), F.lit(sid).alias("sid"), (F.col(text) if text else F.lit("rejected")).alias("error"), own.alias("input"))

    def _settings(self, stage: dict[str, Any]) -> dict[str, Any]:
        """Those of the stage's settings_file, with the inline ones over them."""
        own = stage.get("settings") or {}
        if stage.get("settings_file"):
            with open(with_prefixes(stage["settings_file"], self.prefixes), encoding="utf-8") as file:
                own = deep_merge(filled(json.load(file), self.environ), own)
        return with_prefixes(own, self.prefixes)

    def _stage(self, run: Run, name: str, stage: dict[str, Any], df: DataFrame) -> None:
        tool, settings, policy = stage["tool"], stage["settings"], stage.get("on_error") or "drop"
        if tool == "route":
            for channel, rows in B.route(df, stage["routes"], policy).items():
                run.data[f"{name}.{channel}"] = self._seen(run, f"{name}.{channel}", rows)
            return
        own = self.tools.get(tool) or getattr(self, "_" + tool.replace("-", "_"))
        if tool in ("gate", "checkpoint") and tool not in self.tools:
            out = own(run, name, settings, df)
        else:
            out = own(df, settings) if tool in self.tools else own(name, stage, settings, policy, df)
        if isinstance(out, B.Outputs):
            for kind in ("meta", "trace", "errors"):
                if getattr(out, kind) is not None:
                    getattr(run, kind)[name] = getattr(out, kind)
            out = out.data
        if out is not None:
            run.data[name] = self._seen(run, name, out)

    def _seen(self, run: Run, name: str, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            return df
        run.observations[name] = Observation(f"{name}-{time.time_ns()}")
        return df.observe(run.observations[name], F.count(F.lit(1)).alias("rows_out"))

    def _filter(self, name, stage, settings, policy, df):
        return B.filter_rows(df, stage["expression"], policy)

    def _dedup(self, name, stage, settings, policy, df):
        spec = dict(stage.get("dedup") or {})
        spec.pop("hash_algo", None)  # keys are compared whole
        index = spec.pop("path", None) or (f"{self.session}/index-{spec['index_name']}" if spec.get("index_name") else None)
        spec.pop("index_name", None)
        return B.dedup(df, spec.get("key") or [], on_duplicate=spec.get("on_duplicate", "drop"), index=index, load_existing=spec.get("load_existing", True), label=name)

    def _group_by(self, name, stage, settings, policy, df):
        spec = stage["group_by"]
        out = B.group_by(df, spec["key"], spec["bucket_key_from"], spec["value_from"], spec.get("expected_sources"), spec.get("count_threshold"), spec.get("emit_partial_on_eof", False))
        target = spec.get("target", "labels").removeprefix("v.")
        return out.withColumnRenamed("labels", target) if "." not in target else out.withColumn(target.split(".")[0], F.struct(F.col("labels").alias(target.split(".", 1)[1]))).drop("labels")

    def _spread(self, name, stage, settings, policy, df):
        return df

    def _toggle(self, name, stage, settings, policy, df):
        return B.toggle(df, settings.get("env"), settings.get("value"), settings.get("values"), settings.get("mode", "on"), self.environ)

    def _normalize(self, name, stage, settings, policy, df):
        found = normalize(df, settings.get("rules"), settings.get("profiles"), settings.get("rulebook"), settings.get("on_unmatched", "passthrough"), settings.get("folder", "."))
        return B.Outputs(found.data, trace=found.trace, errors=found.errors)

    def _gate(self, run, name, settings, df):
        """Its state is written by a checkpoint that waits for it, or at the end of execute(), or by settle()."""
        own = settings.get("name", name)
        run.gates[own] = B.Gate(df, own, f"{self.session}/gates/{own}", name)
        return run.gates[own].data

    def _checkpoint(self, run, name, settings, df):
        wanted = settings.get("wait_for_gates") or []
        return B.checkpoint(df, f"{self.session}/spool", [f"{self.session}/gates/{x}" for x in wanted], [run.gates[x] for x in wanted if x in run.gates])

    def _write_file_stream(self, name, stage, settings, policy, df):
        return writers.write_stream(df, settings.get("base", f"{self.session}/{name}"), settings.get("format", "ndjson"), settings.get("default_file", "out"), settings.get("write_mode", "append"), settings.get("csv_columns") or (), pass_through=settings.get("pass_through", False))

    def _write_file_stream_hashed(self, name, stage, settings, policy, df):
        bad = writers.write_hashed(df, settings.get("base", f"{self.session}/{name}"), settings.get("format", "ndjson"), settings.get("default_file", "out"), settings.get("hash_field"), csv_columns=settings.get("csv_columns") or (), sidecar=settings.get("sidecar", True))
        return B.Outputs(None, errors=bad)

    def _read_file_stream(self, name, stage, settings, policy, df):
        paths = [x["path"] for x in df.select("path").collect()]  # a seed names the files to read
        kind = settings.get("format", "ndjson")
        kw = {"skip": settings.get("skip", 0), "limit": settings.get("limit")}
        if not paths:
            raise ValueError(f"{name}: the seed names no file")
        if kind == "csv":
            found = readers.read_csv(self.spark, paths, settings.get("csv_header", True), settings.get("csv_delim", ","), **kw)
        elif kind == "lines":
            found = readers.read_lines(self.spark, paths, **kw)
        else:
            found = readers.read_ndjson(self.spark, paths, settings.get("schema"), **kw)
        if settings.get("passthrough_input"):
            found = readers.with_input(found, df)
        return B.Outputs(found.rows, meta=found.meta, errors=found.errors)

    def _scan_fs(self, name, stage, settings, policy, df):
        if settings.get("mode", "full") == "diff":
            parts = [readers.scan_fs(self.spark, x["root"]) for x in df.select("root").distinct().collect()]
            return readers.scan_diff(df, B.fan_in(parts))
        known = {"return": "returns", "include": "include", "exclude": "exclude", "depth": "depth", "hidden": "hidden", "follow_symlinks": "follow_symlinks", "hash": "hash", "min_size": "min_size", "max_size": "max_size"}
        kw = {own: settings[k] for k, own in known.items() if k in settings}
        rows = [x.asDict() for x in df.collect()]  # a seed names the roots to scan
        extra = (lambda r: {k: v for k, v in r.items() if k != "path" and not k.startswith("_")}) if settings.get("passthrough_input") else (lambda r: {})
        return B.fan_in([readers.scan_fs(self.spark, r["path"], extra=extra(r), **kw) for r in rows])
