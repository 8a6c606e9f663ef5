"""Every query with SQL against DuckDB, and all others for whether they run."""

import math
import os

import duckdb
import pytest

from siltflow import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(v[k]) for k in order] for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name in queries.ORACLES:
        rel = duck.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
    assert got or name in ("dedup_seen_keys", "normalize_errors")
