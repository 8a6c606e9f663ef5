"""User tools: per-record Python functions run by partition.

A tool is a class or module with process_input(v, settings, ctx) and, for queues, functions
process_<queue>.  ctx.output may be called any number of times; an exception becomes an error
record and the next record follows.  Records and results pass as Arrow batches of JSON text.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.operators.accumulators import Registry
from siltflow.operators.builtins import Outputs
from siltflow.operators.scratch import hold

#: Queue steps for one record at most.
QUEUE_STEPS = 100_000
KINDS = ("output", "meta", "trace", "log", "error", "stats")


class Context:
    """What a tool may do with a record; one for each partition, so `memory` holds a partition's state."""

    def __init__(self, cache: dict[str, Any] | None = None):
        self.memory: dict[str, Any] = {}
        self.registry = Registry()
        self._rows: list[tuple[str, str | None, str | None, str]] = []
        self._queue: deque[tuple[str, Any]] = deque()
        self._id: str | None = None
        self._src: str | None = None
        self._cache = {} if cache is None else cache

    def _put(self, kind: str, v: Any, id: str | None = None, src: str | None = None) -> None:
        self._rows.append((kind, id if id is not None else self._id, src if src is not None else self._src, json.dumps(v, ensure_ascii=False)))

    def output(self, v: Any, id: str | None = None, src: str | None = None) -> None:
        self._put("output", v, id, src)

    def meta(self, v: Any) -> None:
        self._put("meta", v)

    def trace(self, key: str, value: Any) -> None:
        self._put("trace", {key: value})

    def log(self, msg: str, level: str = "info") -> None:
        self._put("log", {"level": level, "msg": msg})

    def error(self, v: Any, message: str) -> None:
        self._put("error", {"input": v, "error": message})

    def stats(self, values: dict[str, Any]) -> None:
        self._put("stats", values)

    def emit(self, queue: str, v: Any) -> None:
        self._queue.append((queue, v))

    @staticmethod
    def hash(text: str) -> str:
        return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()

    @staticmethod
    def hash_file(path: str) -> str:
        state = hashlib.blake2b(digest_size=16)
        with open(path, "rb") as file:
            while chunk := file.read(1 << 16):
                state.update(chunk)
        return state.hexdigest()

    def cached(self, namespace: str, key: Any, produce: Callable[[], Any], mode: str = "use") -> Any:
        """A memo: use reads and writes it, refresh only writes, bypass and off do neither."""
        at = f"{namespace}:{json.dumps(key, sort_keys=True)}"
        if mode == "use" and at in self._cache:
            return self._cache[at]
        value = produce()
        if mode in ("use", "refresh"):
            self._cache[at] = value
        return value

    def _drain(self, tool: Any, settings: dict[str, Any]) -> None:
        steps = 0
        while self._queue:
            steps += 1
            if steps > QUEUE_STEPS:
                raise RuntimeError("queues don't run empty")
            name, v = self._queue.popleft()
            handler = getattr(tool, f"process_{name}", None)
            if handler is None:
                raise AttributeError(f"no process_{name}")
            handler(v, settings, self)


def run_tool(df: DataFrame, tool: Any, settings: dict[str, Any] | None = None, accept_meta: bool = False, once: bool = False) -> Outputs:
    """Run a tool over envelopes (_t, _id, _src, v as JSON text) or over plain columns, which become v.

    The results are one DataFrame, split by kind.  With `once` it is written to the shared folder, a
    folder for each kind, and the tool runs once; else the plan is lazy and the tool runs for each
    output that is asked for.
    """
    settings = settings or {}
    if "v" not in df.columns:
        own = [x for x in df.columns if not x.startswith("_")]
        keep = [F.col(x).cast("string") if x in df.columns else F.lit(None).cast("string").alias(x) for x in ("_id", "_src")]
        df = df.select(F.lit("d").alias("_t"), *keep, F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("v"))
    rows = df if accept_meta else df.where(F.coalesce(F.col("_t"), F.lit("d")) != "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = Context()
        for batch in batches:
            for id_, src, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ctx._id, ctx._src = id_, src
                try:
                    v = json.loads(text)
                    tool.process_input(v, settings, ctx)
                    ctx._drain(tool, settings)
                except Exception as e:  # a bad record doesn't end the stage
                    ctx._queue.clear()
                    ctx.error(text, f"{type(e).__name__}: {e}")
            out, ctx._rows = ctx._rows, []
            yield pa.RecordBatch.from_pydict({k: [x[n] for x in out] for n, k in enumerate(("kind", "_id", "_src", "v"))}, pa.schema([(k, pa.string()) for k in ("kind", "_id", "_src", "v")]))

    made = rows.select("_id", "_src", "v").mapInArrow(run, "kind string, _id string, _src string, v string")
    if once:
        made = hold(made, "tool", by="kind")
    part = lambda *kinds: made.where(F.col("kind").isin(*kinds))
    return Outputs(part("output").drop("kind"), part("meta").drop("kind"), part("trace", "log", "stats"), part("error").drop("kind"))


_tools: dict[str, Any] = {}


def tool(name: str) -> Callable[[Any], Any]:
    """Register a tool class or module under a name."""

    def keep(x: Any) -> Any:
        _tools[name] = x
        return x

    return keep


def registered() -> dict[str, Callable]:
    """Registered tools as Runner takes them; each runs once."""
    return {k: (lambda df, settings, own=v: run_tool(df, own() if isinstance(own, type) else own, settings, once=True)) for k, v in _tools.items()}
