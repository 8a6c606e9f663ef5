import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltflow.operators import accumulators as A


def test_states(spark):
    df = spark.createDataFrame([("u", k, x, f, d) for k, (x, f, d) in enumerate([(3, True, False), (5, False, False), (3, True, True), (7, True, False)])], "g string, o long, x long, f boolean, d boolean")
    c = F.col
    row = df.groupBy("g").agg(
        A.number(c("x")).alias("n"), A.average(c("x")).alias("a"), A.min_max(c("x")).alias("m"), A.set_of(c("x")).alias("s"), A.set_of(c("x"), c("d"), c("o")).alias("sd"),
        A.map_of(c("x"), c("o"), c("o")).alias("map"), A.buffer(c("x"), 2, c("o")).alias("b"), A.boolean(c("f"), c("o")).alias("f"), A.toggled(F.lit(1)).alias("t"),
    ).first()
    assert (row.n, row.a, tuple(row.m), row.s, row.sd, row.map, row.b, row.f, row.t) == (18, 4.5, (3, 7, 4), [3, 5, 7], [5, 7], {3: 2, 5: 1, 7: 3}, [3, 7], True, False)
    assert df.where("false").agg(A.number(c("x")), A.average(c("x"))).first() == (0, 0.0)
    assert [r.b for r in df.withColumn("b", A.running_buffer(c("x"), 2, ["g"], ["o"])).orderBy("o").collect()] == [[3], [3, 5], [5, 3], [3, 7]]
    assert [r.n for r in df.withColumn("n", A.running(F.sum("x"), Window.partitionBy("g").orderBy("o"))).orderBy("o").collect()] == [3, 8, 11, 18]


def test_bits_trigger_registry(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "b"), ("w", "a")], "g string, bit string")
    mask = A.BitMask(["a", "b"])
    state = df.groupBy("g").agg(*mask.bits(F.col("bit")))
    assert [r.g for r in A.trigger(state, mask.all()).collect()] == ["u"]
    assert state.where(mask.any("b")).count() == 1
    with pytest.raises(KeyError):
        mask.all("z")
    names = A.Registry()
    names.claim("x", "number")
    with pytest.raises(TypeError):
        names.claim("x", "set")
