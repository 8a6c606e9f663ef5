import pytest

from siltflow.functions import expression as X

SCOPE = {"env": {"t": "d", "id": "i1", "src": "s"}, "v": {"x": 5, "name": "Alice", "arr": [1, 2, 3], "nested": {"deep": 42}, "none": None, "zero": 0, "blank": "", "flag": True}}

CASES = [
    ("v.x == 5", True), ("v.x == 5.0", True), ("v.x != 6", True), ("v.x == '5'", False), ("v.none == null", True), ("v.none != 5", True),
    ("v.x > 3 && v.x < 10", True), ("v.x > 3 && v.missing > 1", "error"), ("v.x > 3 || v.missing > 1", True), ("v.missing > 1 || v.x > 3", "error"),
    ("!v.zero", True), ("!v.blank", True), ("v.nested.deep >= 42", True), ("v.name.first", "error"), ("v.none > 1", "error"), ("v.name > 3", "error"),
    ("lower(v.name) == 'alice'", True), ("includes(v.name, 'LIC')", True), ("startsWith(v.name, 'al')", True), ("endsWith(v.name, 'CE')", True),
    ("length(v.name)", 5), ("length(v.arr)", 3), ("length(v.x)", "error"), ("empty(v.none)", True), ("empty(v.blank)", True), ("empty(v.zero)", False),
    ("contains(v.name, ['zz', 'lic'])", True), ("contains(v.name, ['zz'])", False), ("contains(v.none, ['a'])", "error"),
    ("matches(v.name, 'lic')", True), ("matches(v.name, '^Ali')", True), ("matches(v.name, 'ce$')", True), ("matches(v.name, '^A.*e$')", True), ("matches(v.name, '^lic')", False), ("matches(v.name, '^Al$')", True),
    ("normalize('Acme, Inc') == 'acme'", True), ("normalize('Acmeinc') == 'acmeinc'", True), ("normalize('Acme Foo Ltd') == 'acme foo'", True), ("v.name < 'Bob'", True),
    ("matches(v.name, '^.*ic')", True), ("matches(v.name, 'A.*l.*e')", True), ("matches(v.name, 'e.*A')", False), ("matches(v.name, '.*')", True), ("matches(v.name, '^Alice.*ce$')", True), ("matches(v.name, 'a+')", False), ("matches(v.name, 'x.*ce$')", False),
    ("normalize('Ltd') == ''", True), ("normalize('A_b-c  GmbH') == 'a b c'", True), ("normalize('Acme ltd inc') == 'acme ltd'", True), ("length(v.nested)", 1), ("v.nested == v.nested", True), ("env.id == 'i1'", True), ("(v.x == 1 || v.x == 5) && v.flag", True), ("-5 < v.x", True),
]


@pytest.mark.parametrize("source, want", CASES)
def test_records(source, want):
    if want == "error":
        with pytest.raises(X.EvaluationError):
            X.evaluate(X.parse(source), SCOPE)
    else:
        assert X.same(X.evaluate(X.parse(source), SCOPE), want)


def test_columns_agree_with_records(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("d", "i1", "s", 5, "Alice", [1, 2, 3], (42,), None, 0, "", True)], "_t string, _id string, _src string, x long, name string, arr array<long>, nested struct<deep:long>, none string, zero long, blank string, flag boolean")
    cols, wants = [], []
    for k, (source, _) in enumerate(CASES):
        done = X.compile_expression(source, df.schema)
        cols += [done.value.alias(f"v{k}"), F.coalesce(done.fails if done.fails is not None else F.lit(False), F.lit(False)).alias(f"f{k}"), X.predicate(X.parse(source), df.schema).alias(f"p{k}")]
    row = df.select(*cols).first()
    for k, (source, want) in enumerate(CASES):
        assert row[f"f{k}"] == (want == "error"), source
        if want != "error":
            assert row[f"v{k}"] == want, source
        assert bool(row[f"p{k}"]) == (want != "error" and X.truthy(want)), source


@pytest.mark.parametrize("bad", ["v.x +", "v.x * 2", "foo(v.x)", "lower()", "v.items[0]", "v.x == 1 == 2", "'open"])
def test_rejected(bad):
    with pytest.raises(X.ExpressionError):
        X.parse(bad)


def test_plain_comparisons_are_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("id AS x", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    from siltflow.operators.builtins import filter_rows

    df = filter_rows(spark.read.parquet(str(tmp_path / "t")), "v.x > 5 && v.s == '7'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,5)" in plan and "EqualTo(s,7)" in plan
    assert [r.x for r in df.collect()] == [7]
