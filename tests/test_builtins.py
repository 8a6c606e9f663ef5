import pytest

from siltflow.operators import builtins as B


@pytest.fixture
def rows(spark):
    data = [(0, "a", "alpha", None), (1, "b", "bravo", False), (2, "c", "charlie", True), (3, "a", "alpha", None)]
    return spark.createDataFrame(data, "_ord long, _id string, name string, flag boolean")


def test_filter_policies(spark, rows):
    assert B.filter_rows(rows, "v.flag == true").count() == 1
    assert B.filter_rows(rows, "v.missing > 0").count() == 0
    assert B.filter_rows(rows, "v.missing > 0", "pass").count() == 4
    with pytest.raises(Exception, match="filter failed"):
        B.filter_rows(rows, "v.missing > 0", "fail").count()
    numbers = spark.createDataFrame([(1,), (None,), (5,)], "x long")
    assert {r.x for r in B.filter_rows(numbers, "v.x != 5").collect()} == {1, None}
    assert {r.x for r in B.filter_rows(numbers, "v.x > 1", "pass").collect()} == {5, None}


def test_route_takes_the_first_match(rows):
    out = B.route(rows, {"flagged": "v.flag == true", "catch": "true"})
    assert [r.name for r in out["flagged"].collect()] == ["charlie"]
    assert sorted(r.name for r in out["catch"].collect()) == ["alpha", "alpha", "bravo"]
    assert B.with_channel(rows, {"x": "v.missing > 1", "y": "true"}).where("_channel = 'y'").count() == 4
    assert B.with_channel(rows, {"x": "v.missing > 1", "y": "true"}, "fail").where("_channel IS NULL").count() == 4


def test_dedup(spark, rows, tmp_path):
    assert sorted(r._ord for r in B.dedup(rows, ["name"]).data.collect()) == [0, 1, 2]
    for how in ("trace", "meta", "error"):
        out = B.dedup(rows, ["v.name"], on_duplicate=how)
        side = {"trace": out.trace, "meta": out.meta, "error": out.errors}[how]
        assert sorted(r._ord for r in out.data.collect()) == [0, 1, 2] and [r.k for r in side.collect()] == ["alpha"]
    index = str(tmp_path / "index")
    assert B.dedup(rows.where("name < 'b'"), ["name"], index=index).data.count() == 1
    assert sorted(r.name for r in B.dedup(rows, ["name"], index=index).data.collect()) == ["bravo", "charlie"]
    assert B.dedup(rows, ["name"], index=index).data.count() == 0


def test_dedup_keys(spark):
    df = spark.createDataFrame([(0, 1, "2025-01-01", 202501.0), (1, 1, "2025-01-02", 202501.0), (2, None, "", None), (3, None, None, None)], "_ord long, id long, date string, n double")
    assert B.dedup(df, ["id", "date"]).data.count() == 3  # null and "" are one key
    assert [r._group_key for r in B.group_by(df.where("n IS NOT NULL"), "v.n", "date", "v.id", count_threshold=2).collect()] == ["202501"]
    assert B.dedup(df, []).data.count() == 4


def test_group_by(spark):
    day = lambda *xs: spark.createDataFrame([(k, "d", s, x) for k, (s, x) in enumerate(xs)], "_ord long, day string, src string, row long")
    full = B.group_by(day(("TRY", 100), ("EUR", 28)), "day", "src", "row", expected=["TRY", "EUR"]).collect()
    assert [(r._group_key, r._partial, r.labels) for r in full] == [("d", False, {"TRY": 100, "EUR": 28})]
    assert [r.labels for r in B.group_by(day(("A", 1), ("B", 2), ("C", 3)), "day", "src", "row", count_threshold=3).collect()] == [{"A": 1, "B": 2, "C": 3}]
    part = B.group_by(day(("TRY", 1), ("EUR", 2)), "day", "src", "row", expected=["TRY", "EUR", "USD"], emit_partial=True).collect()
    assert [(r._partial, r.labels) for r in part] == [(True, {"TRY": 1, "EUR": 2})]
    again = B.group_by(day(("A", 1), ("A", 2)), "day", "src", "row", expected=["A"]).orderBy("_seq").collect()
    assert [r.labels for r in again] == [{"A": 1}, {"A": 2}]
    last = B.group_by(day(("A", 1), ("A", 2), ("B", 3)), "day", "src", "row", expected=["A", "B"]).collect()
    assert [r.labels for r in last] == [{"A": 2, "B": 3}]
    one = B.group_by_unique(day(("A", 1), ("B", 3)), "day", "src", "row", ["A", "B"]).collect()
    assert [(r.A, r.B) for r in one] == [(1, 3)]


def test_topology(rows, tmp_path):
    assert len(B.spread(rows, 2)) == 2
    with pytest.raises(ValueError):
        B.spread(rows, 0)
    assert B.fan_in([rows, rows]).count() == 8
    assert B.toggle(rows, "X", value="1", environ={"X": "1"}).count() == 4
    assert B.toggle(rows, "X", value="1", mode="off", environ={"X": "1"}).count() == 0
    assert B.toggle(rows, "X", environ={}).count() == 0 and B.toggle(rows).count() == 4
    assert B.replicas(rows, 3, "hash-id").rdd.getNumPartitions() == 3
    at = str(tmp_path / "gate")
    B.gate(rows, "g", at)
    state = rows.sparkSession.read.json(at).first()
    assert (state["name"], state["count"], state["last_id"], state["predicate_met"]) == ("g", 4, "a", True)
    assert B.checkpoint(rows, str(tmp_path), [at]).count() == 4
