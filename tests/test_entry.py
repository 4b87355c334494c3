"""The driver contract, and every registered query against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from cellscope.plans import oracle, registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["SUBSCRIBER_ID", "HOME_INDEX_1KM", "HOME_APPEARANCE_COUNT",
                          "WORK_INDEX_1KM", "WORK_APPEARANCE_COUNT"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(E.oracle_sql()[name])
    want = _canon(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
