import pytest

from siltflow.functions import records as R


@pytest.fixture
def df(spark):
    texts = ['{"x":5}', '{"x":"5"}', '{"y":1}', '{"x":null}', "not json", '{"x":{"b":1,"a":2}}', '{"x":{"a":2,"b":1}}', '{"x":5.0}', None]
    return spark.createDataFrame([(k, f"i{k}", x) for k, x in enumerate(texts)], "_ord long, _id string, v string")


def ords(x):
    return sorted(r._ord for r in x.collect())


def test_filter(df):
    assert ords(R.filter_records(df, "v.x == 5")) == [0, 7]
    assert ords(R.filter_records(df, "v.x > 1")) == [0, 7]
    assert ords(R.filter_records(df, "v.x > 1", "pass")) == [0, 1, 2, 3, 5, 6, 7]
    assert ords(R.filter_records(df, "env.id == 'i2'")) == [2]
    with pytest.raises(Exception, match="PythonException|missing|order|JSON"):
        R.filter_records(df, "v.x > 1", "fail").collect()


def test_route(df):
    got = {r._ord: r._channel for r in R.channel_of_records(df, {"big": "v.x > 4", "text": "v.x == '5'", "rest": "true"}).collect()}
    assert got == {0: "big", 1: "text", 2: "rest", 3: "rest", 4: None, 5: "rest", 6: "rest", 7: "big", 8: None}


def test_keys_and_dedup(df):
    assert ords(R.dedup_records(df, ["v.x"])) == [0, 2, 4, 5, 8]
    assert ords(R.dedup_records(df, [])) == [0, 1, 2, 3, 4, 5, 7, 8]
