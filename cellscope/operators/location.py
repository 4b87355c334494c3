"""Most-visited cell per subscriber, residents per cell, residents map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def _keys(df: DataFrame) -> list[str]:
    return [S.SUBSCRIBER_ID] + ([S.HW_TIME_FILTER] if S.HW_TIME_FILTER in df.columns else [])


def top_location(counts: DataFrame, one_per_subscriber: bool = True,
                 count_col: str = S.APPEARANCE_COUNT) -> DataFrame:
    """Cell(s) with the highest count per subscriber (and hour class when
    the input has HW_TIME_FILTER).

    ``one_per_subscriber=True``: exactly one row, ties broken by the
    smallest cell id with a null cell last, so reruns agree.
    ``False``: every tied cell.
    Rows without a subscriber id are dropped. Output: [HW_TIME_FILTER,]
    SUBSCRIBER_ID, INDEX_1KM, MAX_APPEARANCE_COUNT.

    A ranking window replaces "max per subscriber, join back, deduplicate":
    one sort within the subscriber partition instead of three shuffles, and
    Spark adds a WindowGroupLimit so only the first row of each group is kept.
    The counts are repartitioned by SUBSCRIBER_ID alone (at most cells x 2
    rows each), so the home / work merge that follows needs no exchange;
    Spark drops the repartition when the input is already partitioned so.
    """
    keys = _keys(counts)
    n = F.col(count_col)
    if one_per_subscriber:
        order = Window.partitionBy(*keys).orderBy(n.desc(), F.col(S.INDEX_1KM).asc_nulls_last())
        pick = F.row_number().over(order)
    else:
        pick = F.rank().over(Window.partitionBy(*keys).orderBy(n.desc()))
    out = [c for c in keys if c != S.SUBSCRIBER_ID]
    return (counts.filter(F.col(S.SUBSCRIBER_ID).isNotNull())
            .repartition(S.SUBSCRIBER_ID)
            .withColumn("_pick", pick)
            .filter(F.col("_pick") == 1)
            .select(*out, S.SUBSCRIBER_ID, S.INDEX_1KM,
                    n.alias(S.MAX_APPEARANCE_COUNT)))


def residents_per_cell(locations: DataFrame) -> DataFrame:
    """Subscribers per cell: [HW_TIME_FILTER,] LOCATION_ID, COUNT_IN_1KM_CELL.
    The null cell is a group of its own."""
    by = [S.HW_TIME_FILTER] if S.HW_TIME_FILTER in locations.columns else []
    return (locations.groupBy(*by, S.INDEX_1KM)
            .agg(F.count(F.lit(1)).alias(S.COUNT_IN_1KM_CELL))
            .select(*by, F.col(S.INDEX_1KM).alias(S.LOCATION_ID), S.COUNT_IN_1KM_CELL))


def residents_map(residents: DataFrame, centres: DataFrame) -> DataFrame:
    """Residents per cell with the cell centre: [HW_TIME_FILTER,]
    LOCATION_ID, LATITUDE, LONGITUDE, COUNT_IN_1KM_CELL. Cells without a
    centre, and the null cell, drop out (inner join).

    Both sides are bounded by the number of cells; whether the centres are
    broadcast is the optimizer's choice, by their size in bytes.
    """
    by = [S.HW_TIME_FILTER] if S.HW_TIME_FILTER in residents.columns else []
    c = centres.select(F.col(S.LOCATION_ID).alias("_cell"), S.LATITUDE, S.LONGITUDE)
    return (residents.join(c, residents[S.LOCATION_ID] == c["_cell"], "inner")
            .select(*by, S.LOCATION_ID, S.LATITUDE, S.LONGITUDE, S.COUNT_IN_1KM_CELL))
