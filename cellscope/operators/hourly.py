"""One-day hourly trajectory: the modal cell of every hour of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def hourly_cell_counts(cdr: DataFrame, year: int, day_of_year: int) -> DataFrame:
    """Calls per subscriber x hour x cell on one day: SUBSCRIBER_ID,
    HOUR_OF_DAY, INDEX_1KM, COUNT_IN_1KM_CELL.

    Aggregated on the full key (with map-side partial counts), so one busy
    subscriber is spread over many tasks. Read the CDR with
    ``period=day_bounds(year, day)`` to let Parquet skip other days.
    """
    return (cdr.filter((F.col(S.YEAR) == year) & (F.col(S.DATE_OF_YEAR) == day_of_year))
            .groupBy(S.SUBSCRIBER_ID, S.HOUR_OF_DAY, S.INDEX_1KM)
            .agg(F.count(F.lit(1)).alias(S.COUNT_IN_1KM_CELL)))


def hourly_top_cell(hourly_counts: DataFrame) -> DataFrame:
    """Most frequent cell per subscriber and hour (smallest id on ties, null
    last): SUBSCRIBER_ID, INDEX_1KM, HOUR_OF_DAY.

    Repartitioned by subscriber (at most 24 x cells rows each), so the
    ranking and the pivot of ``hourly_trajectory`` share one exchange.
    """
    w = (Window.partitionBy(S.SUBSCRIBER_ID, S.HOUR_OF_DAY)
         .orderBy(F.col(S.COUNT_IN_1KM_CELL).desc(), F.col(S.INDEX_1KM).asc_nulls_last()))
    return (hourly_counts.filter(F.col(S.SUBSCRIBER_ID).isNotNull())
            .repartition(S.SUBSCRIBER_ID)
            .withColumn("_pick", F.row_number().over(w))
            .filter(F.col("_pick") == 1)
            .select(S.SUBSCRIBER_ID, S.INDEX_1KM, S.HOUR_OF_DAY))


def hourly_trajectory(top_cells: DataFrame) -> DataFrame:
    """One row per subscriber with 24 columns ``"0"`` .. ``"23"`` holding the
    cell of that hour (null when the subscriber made no call in it). The
    hour list is fixed, so Spark needs no extra job to discover it."""
    return (top_cells.groupBy(S.SUBSCRIBER_ID)
            .pivot(S.HOUR_OF_DAY, list(S.HOURS))
            .agg(F.max(S.INDEX_1KM)))
