import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from cellscope import schemas as S  # noqa: E402
from cellscope.functions.calendar import enrich  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").appName("cellscope-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def cdr(spark):
    """Build an enriched CDR from (subscriber, 'yyyyMMddHHmmss', cell) rows."""
    def make(rows):
        return enrich(spark.createDataFrame(rows, S.CDR))
    return make


@pytest.fixture
def counts_df(spark):
    """Appearance counts from (class, subscriber, cell, count) rows."""
    def make(rows):
        return spark.createDataFrame(
            rows, "HW_TIME_FILTER string, SUBSCRIBER_ID string, INDEX_1KM string, APPEARANCE_COUNT bigint")
    return make


@pytest.fixture
def adjacency_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, S.ADJACENCY)
    return make


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((v is None, str(v)) for v in t))
