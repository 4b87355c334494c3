"""Results with a hot key: a third of all events moved to one subscriber.
Every query must still equal its DuckDB SQL (nothing dropped or capped)."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cellscope.session import scratch_dir
from test_entry import _canon

SF = "/root/testdata/sf0.001"
HOT_ID = -1
QUERIES = ("appearance_counts", "top_locations_with_ties", "home_work_joined", "home_work_with_ties",
           "spatial_home_work", "residents_map", "hourly_trajectory", "regional_records", "user_sample")


@pytest.fixture(scope="module")
def hot_dir(spark):
    root = scratch_dir(spark, "hot")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    hot = F.when(F.rand(11) < 1 / 3, F.lit(HOT_ID).cast("bigint")).otherwise(F.col("user_id"))
    ev.withColumn("user_id", hot).write.parquet(f"{root}/events.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    return root


@pytest.fixture(scope="module")
def duck(hot_dir):
    con = duckdb.connect()
    for t in ("events", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{hot_dir}/{t}.parquet/*.parquet')")
    return con


def test_hot_subscriber_holds_a_third(spark, hot_dir):
    ev = spark.read.parquet(f"{hot_dir}/events.parquet")
    share = ev.filter(F.col("user_id") == HOT_ID).count() / ev.count()
    assert 0.28 < share < 0.38


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql_with_hot_key(spark, hot_dir, duck, name):
    df = E.queries()[name](spark, hot_dir)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(E.oracle_sql()[name])
    want = _canon(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert len(got[1]) > 0
