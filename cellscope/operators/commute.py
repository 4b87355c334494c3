"""Home and work location of each subscriber side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .. import schemas as S

_SIDES = (("HOME", S.HOME_HOUR), ("WORK", S.WORK_HOUR))


def _side_aggregates(is_side, keep_ties: bool) -> list[Column]:
    """Per subscriber: the cell and the count of the rows where
    ``is_side(label, hw_class)`` holds, one pair of columns per side.

    Without ties a side has at most one row, so ``max`` returns it. With ties
    a side's cells are listed: an array sorted ascending, a null cell kept
    and placed last, null when the side is absent. Every tied row of a side
    carries the same (maximal) count.
    """
    cell, cnt = F.col(S.INDEX_1KM), F.col(S.MAX_APPEARANCE_COUNT)
    out = []
    for label, hw in _SIDES:
        mine = is_side(label, hw)
        if keep_ties:
            # array(cell) keeps a null cell, which collect_list would skip.
            cells = F.array_sort(F.flatten(F.collect_list(F.when(mine, F.array(cell)))))
            out.append(F.when(F.size(cells) > 0, cells).alias(f"{label}_INDEX_1KM"))
        else:
            out.append(F.max(F.when(mine, cell)).alias(f"{label}_INDEX_1KM"))
        out.append(F.max(F.when(mine, cnt)).alias(f"{label}_APPEARANCE_COUNT"))
    return out


def merge_home_work(home: DataFrame, work: DataFrame, keep_ties: bool = False) -> DataFrame:
    """Home and work location tables (SUBSCRIBER_ID, INDEX_1KM,
    MAX_APPEARANCE_COUNT) side by side, one row per subscriber seen on either
    side: SUBSCRIBER_ID, HOME_INDEX_1KM, HOME_APPEARANCE_COUNT,
    WORK_INDEX_1KM, WORK_APPEARANCE_COUNT. A subscriber seen on one side only
    keeps nulls on the other.

    Without ``keep_ties`` each input holds at most one row per subscriber
    (``top_location`` output). With ``keep_ties`` the cell columns are sorted
    arrays of every tied cell: the home x work pairs of a full outer join in
    factored form, linear in the number of ties instead of their product.

    A union and one aggregation by subscriber, not a join: the merge holds
    no pair of rows, so a subscriber with many tied cells stays small.
    """
    def side(df: DataFrame, label: str) -> DataFrame:
        return df.select(S.SUBSCRIBER_ID, F.lit(label).alias("_side"),
                         S.INDEX_1KM, S.MAX_APPEARANCE_COUNT)

    tagged = side(home, "HOME").unionByName(side(work, "WORK"))
    return (tagged.filter(F.col(S.SUBSCRIBER_ID).isNotNull())
            .groupBy(S.SUBSCRIBER_ID)
            .agg(*_side_aggregates(lambda label, hw: F.col("_side") == label, keep_ties)))


def home_work(locations: DataFrame, one_per_subscriber: bool = True) -> DataFrame:
    """Home and work side by side from one location table that carries
    HW_TIME_FILTER (the output of ``top_location``); same columns as
    ``merge_home_work``, whose ``keep_ties`` is ``not one_per_subscriber``.

    A conditional aggregation by subscriber puts both classes in one row:
    one pass over the input, and no exchange when the input is already
    partitioned by subscriber (a self-join would get the class filter pushed
    into each side and read the CDR twice).
    """
    cls = F.col(S.HW_TIME_FILTER)
    return (locations.filter(cls.isin(S.HOME_HOUR, S.WORK_HOUR)
                             & F.col(S.SUBSCRIBER_ID).isNotNull())
            .groupBy(S.SUBSCRIBER_ID)
            .agg(*_side_aggregates(lambda label, hw: cls == hw, not one_per_subscriber)))


def cells_as_text(home_work_df: DataFrame, sep: str = ",", null_cell: str = "\\N") -> DataFrame:
    """The tie-keeping form with each cell array rendered as text (cells in
    order, joined by ``sep``, a null cell written as ``null_cell``, by default
    the usual text-dump mark, which is no cell's name), for CSV
    sinks, which cannot hold arrays. Other columns pass unchanged, so the
    one-per-subscriber form is returned as it is."""
    return home_work_df.select(*[
        F.array_join(f.name, sep, null_cell).alias(f.name) if isinstance(f.dataType, ArrayType)
        else F.col(f.name)
        for f in home_work_df.schema.fields])
