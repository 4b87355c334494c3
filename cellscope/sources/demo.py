"""Map the driver's generic tables onto the CDR data model.

``events`` plays the CDR, ``nation`` x ``region`` the cells (a 5 x 5 grid,
one nation per cell) and the adjacency is generated from the nation keys.
Everything is derived by Spark from those tables, so its size follows them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

# 25 cells on a 5-wide grid; the cell of an event is its
# integer props.k modulo 25.
N_CELLS = 25
GRID_WIDTH = 5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cdr_from_events(events: DataFrame,
                    period: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame:
    """Raw CDR rows from ``events``. ``period`` = [start, end) filters ``ts``
    itself, which reaches the Parquet reader as a pushed filter."""
    if period is not None:
        start, end = period
        ts = F.col("ts")
        events = events.filter((ts >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
                               & (ts < F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")))
    # props is a small JSON object. When "k" is its first key, an anchored
    # regular expression reads it (about 3x cheaper than a JSON parse per
    # row); any other layout falls back to the JSON path.
    first = F.regexp_extract("props", r'^\s*\{\s*"k"\s*:\s*(-?[0-9]+)\s*[,}]', 1)
    k = F.coalesce(F.when(first != "", first), F.get_json_object("props", "$.k")).cast("int")
    return events.select(
        F.col("user_id").cast("string").alias(S.SUBSCRIBER_ID),
        F.date_format("ts", "yyyyMMddHHmmss").alias(S.CALL_TIME),
        (k % N_CELLS).cast("string").alias(S.INDEX_1KM),
    )


def cells_from_nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Areas table (all text): one cell per nation, province = region name."""
    k = F.col("n_nationkey")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select(
                (k % GRID_WIDTH).cast("string").alias("LONGITUDE"),
                F.floor(k / GRID_WIDTH).cast("string").alias("LATITUDE"),
                F.lpad(k.cast("string"), 4, "0").alias("DSD_CODE4"),
                F.col("r_name").alias("PROVINCE_NAME"),
                F.col("n_name").alias("DISTRICT_NAME"),
                F.concat(F.lit("DS_"), k.cast("string")).alias("DS_NAME"),
                k.cast("string").alias(S.LOCATION_ID),
                (k + 1).cast("string").alias("BTS_AREA"),
            ))


def centres_from_nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    return cells_from_nations(nation, region).select(S.LOCATION_ID, S.LATITUDE, S.LONGITUDE)


def adjacency_from_nations(nation: DataFrame) -> DataFrame:
    """Four grid neighbours per cell: above, below, left, right; null at
    the border."""
    k = F.col("n_nationkey")

    def cell(c):
        return c.cast("string")

    return nation.select(
        cell(k).alias(S.ADJ_INDEX_1KM),
        F.when(k - GRID_WIDTH >= 0, cell(k - GRID_WIDTH)).alias("ADJ_1"),
        F.when(k + GRID_WIDTH < N_CELLS, cell(k + GRID_WIDTH)).alias("ADJ_2"),
        F.when(k % GRID_WIDTH != 0, cell(k - 1)).alias("ADJ_3"),
        F.when(k % GRID_WIDTH != GRID_WIDTH - 1, cell(k + 1)).alias("ADJ_4"),
    )
