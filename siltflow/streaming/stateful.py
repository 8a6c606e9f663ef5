"""Structured Streaming forms of the operators that keep state; filter, route and normalize work on streams as they are."""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack
from typing import IO, Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from siltflow.functions.expression import resolve
from siltflow.operators.builtins import key_text, segment


def read_lines(spark: SparkSession, folder: str, most_files: int | None = None) -> DataFrame:
    """A stream of lines (value) of files that arrive in a folder."""
    reader = spark.readStream
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.text(folder)


def dedup(df: DataFrame, key: Sequence[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key to arrive.  Keys are kept for good, or with event_time and delay as long as the watermark allows."""
    keyed = df.withColumn("_key", key_text(df, key))
    if event_time and delay:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def _sorter(most: int, piece: int = 4096) -> Callable[[Iterator[pd.DataFrame]], Iterator[tuple]]:
    """All rows (place, label, value) of a key in order, equal places as they came.

    Spark cuts a key's rows into batches wherever an Arrow batch is full, in no order, so sorting
    each batch is not enough.  `most` rows are sorted at a time; sorted runs wait in unnamed files
    in the task's own folder and are merged.  All within one function, so that workers need no
    import of this module.
    """

    def place(row: tuple) -> tuple[bool, Any]:
        """Null comes first, as in Spark."""
        return (True, row[0]) if row[0] is not None and row[0] == row[0] else (False, 0)

    def pieces(run: IO[bytes]) -> Iterator[tuple]:
        run.seek(0)
        while True:
            try:
                yield from pickle.load(run)
            except EOFError:
                return

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        runs: list[IO[bytes]] = []
        rows: list[tuple] = []
        with ExitStack() as files:
            for batch in batches:
                rows.extend(zip(*(batch[c].tolist() for c in "olx"), strict=True))
                if len(rows) >= most:
                    rows.sort(key=place)
                    runs.append(files.enter_context(tempfile.TemporaryFile(dir=folder)))
                    for k in range(0, len(rows), piece):
                        pickle.dump(rows[k : k + piece], runs[-1], pickle.HIGHEST_PROTOCOL)
                    rows.clear()
            rows.sort(key=place)
            yield from heapq.merge(*map(pieces, runs), rows, key=place) if runs else rows

    return in_order


def group_by(df: DataFrame, key: Sequence[str] | str, label: str, value: str, expected: Sequence[str] | None = None, count_threshold: int | None = None, idle_ms: int | None = None, most: int = 250_000) -> DataFrame:
    """group_by on a stream: _group_key, _partial, labels and values (two lists).  A stream has no end: with idle_ms, what a key holds is emitted as partial after so long without a row; after an availableNow run, partial_groups() gives what is left.

    A key's rows are taken by _ord within a micro-batch, and micro-batches as they arrive; about `most` rows of a key are in memory at once.
    """
    paths = [key] if isinstance(key, str) else list(key)
    val, kind = resolve(tuple(value.removeprefix("v.").split(".")), df.schema)
    order = F.col("_ord") if "_ord" in df.columns else F.lit(0)
    rows = df.select(key_text(df, paths).alias("_group_key"), segment(df.schema, label).alias("l"), val.alias("x"), order.cast("string").alias("o") if "_ord" not in df.columns else order.alias("o"))
    wanted = set(expected or [])
    of = kind.simpleString()
    in_order = _sorter(most)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labels, values = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(labels, values, strict=True))
        out: list[tuple] = []

        def made() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["_group_key", "_partial", "labels", "values"])

        if state.hasTimedOut:
            out.append((keys[0], True, list(held), list(held.values())))
            state.remove()
            held = {}
        else:
            for _, l, x in in_order(batches):  # noqa: E741
                held.pop(l, None)
                held[l] = x
                if (wanted <= set(held)) if wanted else (count_threshold and len(held) >= count_threshold):
                    out.append((keys[0], False, list(held), list(held.values())))
                    held = {}
                if len(out) >= 10_000:
                    yield made()
                    out.clear()
            if held:
                state.update((list(held), list(held.values())))
                if idle_ms:
                    state.setTimeoutDuration(idle_ms)
            elif state.exists:
                state.remove()
        if out:
            yield made()

    return rows.groupBy("_group_key").applyInPandasWithState(step, f"_group_key string, _partial boolean, labels array<string>, values array<{of}>", f"labels array<string>, values array<{of}>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def partial_groups(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the groups of an ended group_by stream still hold, as its output with _partial true: the flush at the end of a finite input.

    Read from the state that the query left in its checkpoint folder; the state itself stays.
    """
    state = spark.read.format("statestore").load(checkpoint).select("key._group_key", "value.groupState.*")
    return state.select("_group_key", F.lit(True).alias("_partial"), "labels", "values")


def running_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The gate's and the number accumulator's state by key; output mode update or complete."""
    return df.groupBy(*key).agg(F.count("*").alias("count"))


def windowed(df: DataFrame, event_time: str, width: str, slide: str | None = None, delay: str = "0 seconds", by: Sequence[str] = ()) -> DataFrame:
    """An extra: counts in tumbling or sliding windows of event time, late rows as the watermark allows."""
    return df.withWatermark(event_time, delay).groupBy(F.window(event_time, width, slide or width), *by).agg(F.count("*").alias("n"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what there is, batch by batch, and end.  With a sink that is idempotent by batch id, each row counts once."""
    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
