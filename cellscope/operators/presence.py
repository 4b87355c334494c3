"""Daily presence and appearance counts (days seen per subscriber and cell).

Plan shape, chosen for skew: the distinct runs on the full presence key
(with a map-side partial distinct in front of the exchange, so repeated
calls of a subscriber in a cell on one day merge before they travel), so a
subscriber or cell holding a third of all calls is spread over many tasks by
day. The counts are aggregated on (class, subscriber, cell), again spreading
a hot subscriber by cell. Only the counts table, at most cells x 2 rows per
subscriber, is later repartitioned by subscriber for the ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.classify import hour_class


def daily_presence(cdr: DataFrame, by_year: bool = False) -> DataFrame:
    """One row per subscriber x cell x week x day x hour class.

    Without ``by_year`` the same day and week numbers of two years collapse
    into one row, as in the original jobs; ``by_year=True`` keeps YEAR.
    Calls on both sides of midnight in one night count as two days.
    """
    cols = [F.col(S.SUBSCRIBER_ID), F.col(S.INDEX_1KM)]
    if by_year:
        cols.append(F.col(S.YEAR))
    cols += [F.col(S.WEEK_OF_YEAR), F.col(S.DATE_OF_YEAR),
             hour_class(F.col(S.HOUR_OF_DAY)).alias(S.HW_TIME_FILTER)]
    return cdr.select(*cols).distinct()


def appearance_counts(presence: DataFrame,
                      classes: Sequence[str] = (S.HOME_HOUR, S.WORK_HOUR)) -> DataFrame:
    """Days seen per (hour class, subscriber, cell): HW_TIME_FILTER,
    SUBSCRIBER_ID, INDEX_1KM, APPEARANCE_COUNT (bigint).

    Both classes are counted in one pass (map-side partial counts, one
    exchange on the grouping key).
    """
    return (presence
            .filter(F.col(S.HW_TIME_FILTER).isin(*classes))
            .groupBy(S.HW_TIME_FILTER, S.SUBSCRIBER_ID, S.INDEX_1KM)
            .agg(F.count(F.lit(1)).alias(S.APPEARANCE_COUNT)))


def class_counts(counts: DataFrame, hw_class: str) -> DataFrame:
    """The counts of one hour class, without the class column."""
    return (counts.filter(F.col(S.HW_TIME_FILTER) == hw_class)
            .drop(S.HW_TIME_FILTER))
