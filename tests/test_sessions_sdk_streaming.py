import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltflow.functions.sdk import run_tool
from siltflow.operators import sessions as S
from siltflow.streaming import stateful


def test_sdk(spark):
    class Splitter:
        def process_input(self, v, settings, ctx):
            if v["text"] == "boom":
                raise ValueError("boom")
            ctx.memory["n"] = ctx.memory.get("n", 0) + 1
            ctx.trace("len", len(v["text"]))
            ctx.meta({"seen": v["text"]})
            ctx.emit("word", v["text"])

        def process_word(self, v, settings, ctx):
            for x in v.split():
                ctx.output({"w": ctx.cached("up", x, lambda: x.upper()) + settings["end"]})

    df = spark.createDataFrame([("1", "a b"), ("2", "boom"), ("3", "c")], "_id string, text string")
    out = run_tool(df, Splitter(), {"end": "!"})
    assert sorted((r._id, json.loads(r.v)["w"]) for r in out.data.collect()) == [("1", "A!"), ("1", "B!"), ("3", "C!")]
    assert out.meta.count() == 2 and out.trace.count() == 2
    assert "ValueError: boom" in out.errors.first().v
    runs = spark.sparkContext.accumulator(0)

    class Counted:
        def process_input(self, v, settings, ctx):
            runs.add(1)
            ctx.output(v)
            ctx.meta(v)

    once = run_tool(df, Counted(), once=True)
    assert once.data.count() == once.meta.count() == 3 and once.errors.count() == 0 and runs.value == 3


def test_log_and_journal(spark):
    entries = spark.createDataFrame([(1, "a", "Start"), (3, "b", "done [x]")], "t long, sid string, msg string")
    errors = spark.createDataFrame([(2, "a", "bad", '{"k":"START"}')], "t long, sid string, error string, input string")
    assert [r.t for r in S.log(entries, errors).collect()] == [1, 2, 3]
    assert [r.t for r in S.log(entries, errors, tail=2).collect()] == [2, 3]
    assert [r.t for r in S.log(entries, errors, search="start").collect()] == [1, 2]
    assert [r.t for r in S.log(entries, errors, search="[x]").collect()] == [3]
    assert [r.t for r in S.log(entries, errors, stage="a", only="error").collect()] == [2]
    rows = S.journal(["a", "b", "c"], spark.createDataFrame([("a",), ("a",)], "sid string"), errors)
    assert {(r.sid, r.rows_out, r.errors) for r in rows.collect()} == {("a", 2, 1), ("b", 0, 0), ("c", 0, 0)}
    assert S.journal_totals(rows).first() == (2, 2, 1)
    trace = spark.createDataFrame([("c", "b"), ("b", "a")], "id string, src string")
    walk = S.provenance(trace, spark.createDataFrame([("c",)], "id string"))
    assert {(r.step, r["at"]) for r in walk.collect()} == {(0, "c"), (1, "b"), (2, "a")}
    circle = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "b"), ("a", "x")], "id string, src string")
    walk = S.provenance(circle, spark.createDataFrame([("c",)], "id string"))
    assert sorted((r.step, r["at"]) for r in walk.collect()) == [(0, "c"), (1, "b"), (2, "a"), (3, "x")]
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(5)], "id string, src string")
    with pytest.raises(RuntimeError):
        S.provenance(chain, spark.createDataFrame([("0",)], "id string"), most_steps=4)
    assert S.provenance(chain, spark.createDataFrame([("0",)], "id string"), most_steps=5).count() == 6


def test_snapshots(spark):
    a = spark.createDataFrame([("1", 5, "2024-01-01", "x1"), ("2", 6, "2024-01-02", "x2")], "_id string, n long, d string, s string")
    b = spark.createDataFrame([("9", 5, "2025-01-01", "x3"), ("8", 6, "nope", "x4")], "_id string, n long, d string, s string")
    assert S.compare(a, a).count() == 0
    how = {"matchers": {"d": "is_iso8601"}, "scrub": [("\\d", "#")]}
    assert {r.side for r in S.compare(a, b, **how).collect()} == {"missing", "unexpected"} and S.compare(a, b, **how).count() == 2
    assert S.compare(a, b, matchers={"d": "is_string", "s": ("regex", "^x"), "n": ("in_range", 0, 9)}).count() == 0
    assert len(S.channel_shape(["data"], {"errors": 1})) == 2
    assert S.tree_diff({"a": b"1", "b": b"2"}, {"b": b"3", "c": b"4"}) == {"missing": ["a"], "unexpected": ["c"], "different": ["b"]}
    assert S.traced(a, "s", {"k": F.col("s")}).first().labels == {"k": "x1"}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(([("d", "A", 1), ("d", "A", 2), ("e", "A", 3)], [("d", "B", 4), ("e", "A", 5)])):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("g", "l", "x", "_ord"), (*r, n), strict=True))) for n, r in enumerate(rows)))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the order in which they arrive
    stream = spark.readStream.schema("g string, l string, x long, _ord long").option("maxFilesPerTrigger", 1).json(str(source))
    got = []
    keep = lambda df, _: got.extend(df.collect())
    stateful.run_available(stateful.group_by(stream, "g", "l", "x", expected=["A", "B"]), keep, str(tmp_path / "c1"))
    assert [(r._group_key, r._partial, dict(zip(r.labels, r["values"]))) for r in got] == [("d", False, {"A": 2, "B": 4})]
    left = stateful.partial_groups(spark, str(tmp_path / "c1")).collect()
    assert [(r._group_key, r._partial, dict(zip(r.labels, r["values"]))) for r in left] == [("e", True, {"A": 5})]
    got.clear()
    stateful.run_available(stateful.dedup(stream, ["g", "l"]), keep, str(tmp_path / "c2"))
    assert sorted((r.g, r.l) for r in got) == [("d", "A"), ("d", "B"), ("e", "A")]


@pytest.mark.parametrize("most", [1_000, 8])
def test_stream_group_by_orders_a_key_over_all_its_batches(spark, tmp_path, most):
    rows = [(k, key, label, n * 37 % 100) for k, (key, label, n) in enumerate((key, label, n) for n in range(100) for key in "de" for label in "AB")]
    spark.createDataFrame([(key, label if key == "d" else "A", at) for _, key, label, at in rows], "g string, l string, _ord long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, l string, _ord long").json(str(tmp_path / "in"))
    got, was = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        groups = stateful.group_by(stream, "g", "l", "_ord", expected=["A", "B"], most=most)
        stateful.run_available(groups, lambda df, _: got.extend(df.collect()), str(tmp_path / "c"))
        left = stateful.partial_groups(spark, str(tmp_path / "c")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    # each place of d has an A and a B, so groups fill in order; e has A only, and its last row is at 99
    assert [r["values"] for r in got] == [[k, k] for k in range(100)]
    assert [(r._group_key, r.labels, r["values"]) for r in left] == [("e", ["A"], [99])]


def test_rows_of_a_key_in_order():
    batches = [pd.DataFrame({"o": o, "l": list("abc"), "x": x}) for o, x in (([5, 1, 3], [1, 2, 3]), ([2.0, None, 3.0], [4, 5, 6]), ([2**53 + 2, 2**53 + 1, 3], [7, 8, 9]))]
    for most in (1, 4, 100):
        assert [x for _, _, x in stateful._sorter(most, piece=2)(iter(batches))] == [5, 2, 4, 3, 6, 9, 1, 8, 7]
