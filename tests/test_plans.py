import json

import pytest

from siltflow.plans.runner import Runner
from siltflow.plans.variant import Variant, VariantError, deep_merge, interpolate, load_variant, order, prefixes_in_text, to_token, validate, with_prefixes


def write(folder, name, spec):
    (folder / f"{name}.json").write_text(json.dumps(spec))


def test_inheritance(tmp_path):
    write(tmp_path, "base", {"variant": "base", "stages": {"a": {"tool": "filter", "expression": "v.x > 1", "settings": {"p": [1], "q": 1}}}})
    write(tmp_path, "child", {"variant": "child", "extends": "base", "overrides": {"a": {"settings": {"p": [2]}}}, "stages": {"b": {"tool": "spread", "input": "a"}}})
    got = load_variant(str(tmp_path), "child")
    assert got.stages["a"]["settings"] == {"p": [2], "q": 1} and set(got.stages) == {"a", "b"}
    write(tmp_path, "x", {"extends": "y"})
    write(tmp_path, "y", {"extends": "x"})
    write(tmp_path, "z", {"extends": "base", "overrides": {"nope": {}}})
    for bad in ("x", "z", "missing"):
        with pytest.raises(VariantError):
            load_variant(str(tmp_path), bad)
    assert deep_merge({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}


def test_interpolation():
    env = {"A": "1", "B": ""}
    assert interpolate("x${A}y", env) == "x1y"
    assert interpolate("${C:-d${A}}", env) == "d1" and interpolate("${C:-${D:-z}}", env) == "z"
    assert interpolate("${B:-d}", env) == "" and interpolate("<${B}>", env) == "<>"  # set, if to nothing
    assert interpolate("\\${A}", env) == "${A}"
    for bad in ("${C}", "${A"):
        with pytest.raises(VariantError):
            interpolate(bad, env)
    assert with_prefixes({"p": "$input/a", "q": "$other/b"}, {"input": "/data"}) == {"p": "/data/a", "q": "$other/b"}
    where = {"input": "/data/", "my-dir": "/m"}
    assert prefixes_in_text("startsWith(v.p, '$input/a') || v.q == '$my-dir' || v.r == '$where'", where) == "startsWith(v.p, '/data/a') || v.q == '/m' || v.r == '$where'"
    assert to_token("/data/in/x", {"d": "/data", "i": "/data/in"}) == "$i/x"


def test_validation():
    stages = {
        "r": {"tool": "route", "routes": {"a": "v.x >", "b": "true"}},
        "f": {"tool": "filter", "input": "r.c", "expression": "v.x > 1"},
        "g": {"tool": "nope", "input": ["$input", "f"], "typo": 1},
        "s": {"tool": "spread", "input": "missing"},
        "h": {"tool": "filter", "input": "f", "expression": "${NOPE}"},
        "i": {"tool": "filter", "input": "f"},
    }
    text = "; ".join(validate(Variant("v", "p", stages), environ={}))
    for part in ("unexpected", "no channel", "unknown tool", "unknown field 'typo'", "cannot be merged", "doesn't exist", "spread has no consumer", "NOPE", "no expression", "consumers"):
        assert part in text, part
    with pytest.raises(VariantError):
        order({"a": {"input": "b"}, "b": {"input": "a"}})
    assert order({"b": {"input": "a"}, "a": {}, "c": {"input": ["a", "b"]}}) == ["a", "b", "c"]


def test_run(spark, tmp_path):
    stages = {
        "clean": {"tool": "normalize", "settings": {"rules": [{"op": "parse_number", "path": "v.n", "on_error": "error"}]}},
        "first": {"tool": "dedup", "input": "clean", "dedup": {"key": ["v.k"], "on_duplicate": "meta"}},
        "by": {"tool": "route", "input": "first", "routes": {"high": "v.n > ${LIMIT:-10}", "low": "true"}},
        "all": {"tool": "spread", "input": ["by.low", "by.high"]},
        "out": {"tool": "write-file-stream", "input": "all", "settings": {"base": "$session/files", "pass_through": True}},
        "groups": {"tool": "group-by", "input": "all", "group_by": {"key": "v.g", "bucket_key_from": "v.k", "value_from": "v.n", "target": "v.parts", "count_threshold": 2}},
        "held": {"tool": "checkpoint", "input": "gate", "settings": {"wait_for_gates": ["g"]}},
        "gate": {"tool": "gate", "input": "out", "settings": {"name": "g"}},
    }
    df = spark.createDataFrame([(0, "a", "1", "x"), (1, "b", "20", "x"), (2, "a", "3", "y"), (3, "c", "bad", "y")], "_ord long, k string, n string, g string")
    run = Runner(spark, str(tmp_path), environ={}).compile(Variant("v", "p", stages), df)
    assert {(r.k, r.n) for r in run.data["held"].collect()} == {("a", 1.0), ("b", 20.0)}
    assert run.errors["clean"].count() == 1 and run.meta["first"].count() == 1
    assert [r.parts for r in run.data["groups"].collect()] == [{"a": 1.0, "b": 20.0}]
    assert {x["sid"]: x["rows_out"] for x in run.journal() if x["sid"] == "held"} == {"held": 2}
    assert set(run.leaves(Variant("v", "p", stages))) >= {"held", "groups"}
    with pytest.raises(VariantError):
        Runner(spark, str(tmp_path)).compile(Variant("v", "p", {"a": {"tool": "nope"}}), df)


def test_read_and_scan_tools(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"x":1}\nbad\n{"x":5}\n')
    seed = spark.createDataFrame([(str(tmp_path / "in" / "a.ndjson"),)], "path string")
    stages = {"read": {"tool": "read-file-stream", "settings": {"schema": "x long"}}, "keep": {"tool": "filter", "input": "read", "expression": "v.row.x > 2"}}
    run = Runner(spark, str(tmp_path)).compile(Variant("v", "p", stages), seed)
    assert [r.row.x for r in run.data["keep"].collect()] == [5] and run.errors["read"].count() == 1
    scan = Runner(spark, str(tmp_path)).compile(Variant("v", "p", {"s": {"tool": "scan-fs"}}), spark.createDataFrame([(str(tmp_path / "in"),)], "path string"))
    assert [r.filename for r in scan.data["s"].collect()] == ["a"]


def test_settings_file_and_passthrough(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"x":1}\n{"x":5}\n')
    (tmp_path / "conf.json").write_text(json.dumps({"format": "ndjson", "schema": "x long", "skip": 1, "limit": "${N:-7}"}))
    seed = spark.createDataFrame([(str(tmp_path / "a.ndjson"), "north")], "path string, region string")
    stages = {"read": {"tool": "read-file-stream", "settings_file": "$here/conf.json", "settings": {"limit": 3, "passthrough_input": True}}}
    runner = Runner(spark, str(tmp_path / "s"), environ={}, prefixes={"here": str(tmp_path)})
    assert [(r.row.x, r.region) for r in runner.compile(Variant("v", "p", stages), seed).data["read"].collect()] == [(5, "north")]
    stages["read"]["settings_file"] = "$here/none.json"
    stages["read"]["env"] = ["NEEDED"]
    text = "; ".join(validate(Variant("v", "p", stages), environ={}, prefixes={"here": str(tmp_path)}))
    assert "settings_file" in text and "NEEDED" in text
    missing = {"n": {"tool": "normalize", "settings": {"rulebook": str(tmp_path / "nope.json")}}}
    assert "rulebook" in "; ".join(validate(Variant("v", "p", missing), environ={}))


def test_session(spark, tmp_path):
    stages = {
        "clean": {"tool": "normalize", "settings": {"rules": [{"op": "parse_number", "path": "v.n", "on_error": "error"}]}},
        "big": {"tool": "filter", "input": "clean", "expression": "v.n > 1", "trace": False},
    }
    df = spark.createDataFrame([(0, "a", "f:1", "1"), (1, "b", "f:2", "20"), (2, "c", "f:3", "bad")], "_ord long, _id string, _src string, n string")
    runner = Runner(spark, str(tmp_path / "s"), environ={})
    run = runner.execute(Variant("v", "p", stages), df)
    table = runner.session_table
    assert [r._id for r in run.data["big"].collect()] == ["b"]
    assert {(r.sid, r.rows_in, r.rows_out, r.errors) for r in table("stages").collect()} == {("clean", None, 2, 1), ("big", 2, 1, 0)}
    assert {(r.id, r.sid) for r in table("trace").collect()} == {("a", "clean"), ("b", "clean")}  # not of a stage whose trace is off
    assert [(r.sid, json.loads(r.input)["_id"]) for r in table("errors").collect()] == [("clean", "c")]
    assert {(r.sid, r.rows_out, r.errors, r.state) for r in table("journal").collect()} == {("clean", 2, 1, "failed"), ("big", 0, 0, "ok")}
    from siltflow.operators import sessions as S

    assert [r.sid for r in S.log(table("log"), table("errors"), search="cannot convert").collect()] == ["clean"]
    assert {(r.step, r["at"]) for r in S.provenance(table("trace"), spark.createDataFrame([("a",)], "id string")).collect()} == {(0, "a"), (1, "f:1")}
