import pytest

from siltflow.functions.normalize import OPERATIONS, RuleError, normalize

NBSP = " "

# Pairs that must come out as they stand, as FIXTURES.md lists them.
GOLDEN = [
    ("string", f"{NBSP} hello {NBSP}", {"op": "trim"}, "hello"),
    ("string", "  a \t b\n", {"op": "collapse_whitespace"}, "a b"),
    ("string", "hello-world it's", {"op": "case", "to": "title"}, "Hello-World It'S"),
    ("string", "hELLO wORLD. next", {"op": "case", "to": "sentence"}, "Hello world. next"),
    ("string", "Abc", {"op": "case", "to": "upper"}, "ABC"),
    ("string", "-", {"op": "null_if", "values": ["", "-"]}, None),
    ("string", "a", {"op": "null_if", "values": ["", "-"]}, "a"),
    ("string", "Café  Olé!", {"op": "slugify"}, "cafe-ole"),
    ("string", "Привет", {"op": "slugify"}, ""),
    ("string", "!!hello!!", {"op": "slugify"}, "hello"),
    ("string", "é", {"op": "normalize_unicode"}, "é"),
    ("string", "foo 42", {"op": "replace", "pattern": "(\\d+)", "with": "[$1]", "regex": True}, "foo [42]"),
    ("string", "a.b.c", {"op": "replace", "pattern": ".", "with": "-"}, "a-b-c"),
    ("string", "Fee 1", {"op": "dict", "map": {"Fee 1": "fee", "/^Fee (\\d+)$/": "fee_$1"}}, "fee"),
    ("string", "Column 5", {"op": "dict", "map": {"Fee 1": "fee", "/^Column (\\d+)$/": "col_$1"}}, "col_5"),
    ("string", "other", {"op": "dict", "map": {"a": "b"}, "default": "null"}, None),
    ("string", "other", {"op": "dict", "map": {"a": "b"}}, "other"),
    ("string", "1 234,56", {"op": "parse_number", "decimal": ",", "thousand": " "}, 1234.56),
    ("string", "($1,000.50)", {"op": "parse_number", "thousand": ",", "parens_negative": True}, -1000.5),
    ("string", "3,8%", {"op": "parse_number", "decimal": ",", "percent": True}, pytest.approx(0.038)),
    ("string", "1.2.3", {"op": "parse_number"}, None),
    ("string", "", {"op": "parse_number"}, None),
    ("string", "1e5", {"op": "parse_number"}, None),
    ("boolean", True, {"op": "parse_number"}, 1.0),
    ("double", 0.5, {"op": "round", "decimals": 0}, 1.0),
    ("double", -1.5, {"op": "round", "decimals": 0}, -2.0),
    ("double", 1.005, {"op": "round", "decimals": 2}, 1.0),
    ("double", 3.15789, {"op": "round", "decimals": 2}, 3.16),
    ("double", 2.0, {"op": "scale", "factor": 1.5}, 3.0),
    ("double", -5.0, {"op": "clamp", "min": 0}, 0.0),
    ("double", -5.0, {"op": "abs"}, 5.0),
    ("string", "15.01.2025", {"op": "parse_date", "formats": ["%Y-%m-%d", "%d.%m.%Y"]}, "2025-01-15"),
    ("string", "2025-06-15", {"op": "parse_date", "formats": ["%Y-%m-%d"], "assume_tz": "Europe/London", "output": "datetime"}, "2025-06-14T23:00:00+00:00"),
    ("string", "2025-01-15T10:00:00+0200", {"op": "parse_date", "formats": ["%Y-%m-%dT%H:%M:%S%z"], "output": "iso"}, "2025-01-15T08:00:00+00:00"),
    ("string", "2025-03-30 01:30:00", {"op": "parse_date", "formats": ["%Y-%m-%d %H:%M:%S"], "assume_tz": "Europe/London"}, None),
    ("long", 86400, {"op": "parse_date", "formats": []}, "1970-01-02"),
    ("long", 1700000000000, {"op": "parse_date", "formats": []}, "2023-11-14"),
    ("long", 1700000000000, {"op": "parse_date", "formats": [], "output": "epoch_ms"}, 1700000000000),
    ("string", " Да ", {"op": "parse_bool"}, True),
    ("string", "maybe", {"op": "parse_bool"}, None),
    ("long", 0, {"op": "parse_bool"}, False),
    ("string", "€", {"op": "normalize_currency"}, "EUR"),
    ("string", "xyz", {"op": "normalize_currency"}, "XYZ"),
    ("string", "??", {"op": "normalize_currency"}, None),
    ("string", "??", {"op": "normalize_currency", "fallback": "USD"}, "USD"),
    ("array<string>", [" a ", None], {"op": "trim"}, ["a", None]),
    ("array<string>", ["1", "x"], {"op": "parse_number"}, None),
]


@pytest.mark.parametrize("kind", sorted({x[0] for x in GOLDEN}))
def test_scalars(spark, kind):
    cases = [x for x in GOLDEN if x[0] == kind]
    df = spark.createDataFrame([tuple(x[1] for x in cases)], ", ".join(f"c{k} {kind}" for k in range(len(cases))))
    row = normalize(df, [{**rule, "path": f"v.c{k}"} for k, (_, _, rule, _) in enumerate(cases)]).data.first()
    for k, (_, given, rule, want) in enumerate(cases):
        assert row[k] == want, (given, rule, row[k])


def test_all_operations_are_there():
    assert len(OPERATIONS) == 33


def test_shapes(spark):
    df = spark.createDataFrame([("John Smith", None, "", 7.0, "1 234,56 €", ["5", "=ROUND(1)"], [1, 2], (1, 2))], "name string, a string, b string, n double, price string, cell array<string>, arr array<long>, o struct<p:long,q:long>")
    row = normalize(df, [
        {"op": "split_field", "field": "name", "separator": " ", "into": ["first", "last", "third"]},
        {"op": "join_fields", "fields": ["first", "a", "n"], "separator": "-", "into": "joined"},
        {"op": "coalesce", "fields": ["a", "b", "last"], "into": "filled"},
        {"op": "template", "template": "{{literal-{x}-}} {arr} {gone}", "from": {"x": "v.first", "arr": "v.arr"}, "target": "v.text"},
        {"op": "split_amount_currency", "path": "v.price", "target_amount": "amount", "target_currency": "currency", "decimal": ",", "thousand": " "},
        {"op": "unwrap_formulas", "path": "v.cell"},
        {"op": "compute", "expression": "v.n > 5 && v.first == 'John'", "target": "v.big"},
        {"op": "add_field", "field": "k", "value": 3},
        {"op": "rename", "map": {"k": "kk"}},
        {"op": "prefix_keys", "path": "v.o", "value": "x_"},
        {"op": "drop_fields", "fields": ["*ed"]},
        {"op": "add_field", "path": "v.o", "field": "y", "value": "z"},
    ]).data.first().asDict(recursive=True)
    assert row["first"], row["last"] == ("John", "Smith")
    assert row["third"] is None and "name" not in row
    assert row["text"] == "{literal-John-} [1,2] "
    assert (row["amount"], row["currency"]) == (1234.56, "€")
    assert row["cell"] == "5" and row["big"] is True and row["kk"] == 3
    assert row["o"] == {"x_p": 1, "x_q": 2, "y": "z"}
    assert "joined" not in row and "filled" not in row


@pytest.mark.parametrize("how, want", [("array", {"fee": [5, 1], "tax": 2}), ("suffix", {"fee_1": 5, "fee_2": 1, "tax": 2}), ("first", {"fee": 5, "tax": 2}), ("last", {"fee": 1, "tax": 2}), ("max", {"fee": 5, "tax": 2}), ("sum", {"fee": 6, "tax": 2}), ("error", None)])
def test_to_object(spark, how, want):
    df = spark.createDataFrame([(["fee", "tax", "fee"], [5, 2, 1])], "k array<string>, x array<long>")
    got = normalize(df, [{"op": "to_object", "keys": "v.k", "values": "v.x", "target": "v.o", "on_duplicate": how}]).data.first().o
    assert (got if how != "array" else {k: x.toPython() for k, x in got.items()}) == want


def test_to_object_names_that_meet(spark):
    df = spark.createDataFrame([(["fee_1", "fee", "fee"], [5, 2, 1])], "k array<string>, x array<long>")
    made = normalize(df, [{"op": "to_object", "keys": "v.k", "values": "v.x", "target": "v.o", "on_duplicate": "suffix"}]).data
    assert made.first().o == {"fee_1": 2, "fee_2": 1}


def test_many_date_formats(spark):
    """The plan grows in proportion to the formats; the first that fits decides."""
    formats = [f"%Y{x}%m{x}%d" for x in "-/._ "] + ["%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y", "%Y%m%d", "%d%m%Y", "%H:%M:%S %d.%m.%Y", "%d %m %Y"]
    df = spark.createDataFrame([("2024-05-06",), ("07.08.2023",), ("05:06:07 01.02.2022",), ("x",), ("",)], "s string")
    rule = {"op": "parse_date", "path": "v.s", "formats": formats, "assume_tz": "Europe/London", "output": "date"}
    out = normalize(df, [rule])
    assert sorted((r.s for r in out.data.collect()), key=repr) == sorted(["2024-05-05", "2023-08-06", "2022-02-01", None, None], key=repr)
    assert out.trace.count() == 1


def test_policies(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x")], "id long, s string")
    run = lambda policy: normalize(df, [{"op": "parse_number", "path": "v.s", "on_error": policy}])
    assert [r.s for r in run("null").data.orderBy("id").collect()] == [1.0, None]
    traced = run("trace")
    assert [r.s for r in traced.data.orderBy("id").collect()] == [1.0, None] and traced.trace.count() == 1
    assert [r.id for r in run("drop").data.collect()] == [1] and run("drop").errors.count() == 0
    assert run("error").errors.first()._error.startswith("rule_0") and run("quarantine").data.count() == 1
    assert [r.s for r in run("passthrough").data.orderBy("id").collect()] == ["1", "x"]


def test_require_and_profiles(spark):
    df = spark.createDataFrame([(1, "", 0), (2, "a", 0), (3, "b", None)], "id long, s string, n long")
    assert [r.id for r in normalize(df, [{"op": "require", "fields": ["s", "n"]}]).data.collect()] == [2]
    profiles = [{"when": "v.s == 'a'", "rules": [{"op": "case", "path": "v.s", "to": "upper"}]}, {"when": "v.n == 0", "rules": [{"op": "add_field", "field": "m", "value": "zero"}]}]
    out = normalize(df, profiles=profiles)
    assert {(r.id, r.s, r.m) for r in out.data.collect()} == {(1, "", "zero"), (2, "A", None), (3, "b", None)}
    assert normalize(df, profiles=profiles, on_unmatched="error").errors.first().id == 3


@pytest.mark.parametrize("rule", [{"op": "nope"}, {"op": "trim", "on_error": "nope"}, {"op": "round"}, {"op": "case", "to": "odd", "path": "v.s"}])
def test_bad_rules(spark, rule):
    with pytest.raises(RuleError):
        normalize(spark.createDataFrame([("a",)], "s string"), [rule])


def test_profiles_that_use_a_file(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    (tmp_path / "up.json").write_text(json.dumps({"rules": [{"op": "case", "path": "v.s", "to": "upper"}]}))
    (tmp_path / "book.json").write_text(json.dumps({"profiles": [{"when": "v.id == 1", "use": "up.json"}, {"rules": []}]}))
    assert sorted(r.s for r in normalize(df, rulebook=str(tmp_path / "book.json")).data.collect()) == ["A", "b"]
    (tmp_path / "deep.json").write_text(json.dumps({"profiles": [{"rules": []}]}))
    for bad in ({"use": "deep.json"}, {"use": "up.json", "rules": []}, {"when": "v.id == 1"}):
        with pytest.raises((RuleError, OSError)):
            normalize(df, profiles=[bad], folder=str(tmp_path))
