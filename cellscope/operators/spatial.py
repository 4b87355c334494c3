"""Spatial certainty: a cell also earns part of the days seen in its
neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S

SLOT_COUNTS = tuple(f"{s}_APPEARANCE_COUNT" for s in S.ADJ_SLOTS)


def unique_adjacency(adjacency: DataFrame) -> DataFrame:
    """(_cell, _neighbours: array of the four slots), one row per cell.

    A cell with two adjacency rows would be credited twice, so the query fails
    with its name instead. Rows without a cell are dropped.
    """
    slots = F.array(*S.ADJ_SLOTS)
    message = F.concat(F.lit("adjacency has more than one row for cell "), F.col("_cell"))
    return (adjacency.filter(F.col(S.ADJ_INDEX_1KM).isNotNull())
            .groupBy(F.col(S.ADJ_INDEX_1KM).alias("_cell"))
            .agg(F.count(F.lit(1)).alias("_n"), F.first(slots).alias("_slots"))
            .select("_cell", F.when(F.col("_n") == 1, F.col("_slots"))
                    .otherwise(F.raise_error(message).cast("array<string>")).alias("_neighbours")))


def spatial_appearance(counts: DataFrame, adjacency: DataFrame,
                       weight: float = 0.5) -> DataFrame:
    """Counts with neighbour credit.

    Input: appearance counts ([HW_TIME_FILTER,] SUBSCRIBER_ID, INDEX_1KM,
    APPEARANCE_COUNT) and an adjacency table (ADJ_INDEX_1KM, ADJ_1..ADJ_4);
    a repeated ADJ_INDEX_1KM fails the query. Output: [HW_TIME_FILTER,]
    SUBSCRIBER_ID, INDEX_1KM, ADJ_1..ADJ_4_APPEARANCE_COUNT (the subscriber's
    count in each neighbour, 0 when unseen), ADJ_APPEARANCE (their sum) and
    APPEARANCE_COUNT (double) = own count + weight x ADJ_APPEARANCE.

    Only cells the subscriber was seen in are candidates; a cell missing
    from the adjacency (or the null cell) keeps its own count, and so does
    every cell of the null subscriber, who is nobody in particular.

    Each count row looks up its own adjacency row and asks for the counts of
    its neighbours: itself and at most four requests, whatever cells share a
    neighbour id. Within the subscriber's rows a window over the asked cell
    answers the requests, and one aggregation per asking cell collects the
    answers. The counts are repartitioned by SUBSCRIBER_ID (at most cells x 2
    rows per subscriber); lookup, window and aggregation keep that
    partitioning, which ``top_location`` then reuses: one exchange of the
    counts table for spatial credit and ranking together.
    """
    cls = [S.HW_TIME_FILTER] if S.HW_TIME_FILTER in counts.columns else []
    cell, n = F.col(S.INDEX_1KM), F.col(S.APPEARANCE_COUNT)
    own = F.struct(cell.alias("_asked"), F.lit(0).alias("_slot"), n.alias("_n"))
    requests = [F.struct(F.get("_neighbours", F.lit(i)).alias("_asked"), F.lit(i + 1).alias("_slot"),
                         F.lit(None).cast("bigint").alias("_n")) for i in range(len(S.ADJ_SLOTS))]
    kept = F.filter(F.array(own, *requests),
                    lambda r: (r["_slot"] == 0) | (r["_asked"].isNotNull()
                                                   & F.col(S.SUBSCRIBER_ID).isNotNull()))
    rows = (counts.repartition(S.SUBSCRIBER_ID)
            .join(unique_adjacency(adjacency), cell == F.col("_cell"), "left")
            .select(S.SUBSCRIBER_ID, *cls, S.INDEX_1KM, F.inline(kept)))
    asked = Window.partitionBy(S.SUBSCRIBER_ID, *cls, "_asked")
    answered = rows.withColumn("_n", F.max("_n").over(asked))
    slot = F.col("_slot")
    agg = (answered.groupBy(S.SUBSCRIBER_ID, *cls, S.INDEX_1KM)
           .agg(F.sum(F.when(slot == 0, F.col("_n"))).alias("_own"),
                *[F.sum(F.when(slot == i, F.col("_n"))).alias(c)
                  for i, c in enumerate(SLOT_COUNTS, start=1)]))
    slot_cols = [F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in SLOT_COUNTS]
    adj_sum = slot_cols[0] + slot_cols[1] + slot_cols[2] + slot_cols[3]
    return agg.select(
        *cls, S.SUBSCRIBER_ID, S.INDEX_1KM,
        *[c.alias(name) for c, name in zip(slot_cols, SLOT_COUNTS)],
        adj_sum.alias(S.ADJ_APPEARANCE),
        (F.col("_own") + adj_sum * F.lit(float(weight))).cast("double").alias(S.APPEARANCE_COUNT),
    )


def spatial_stages(counts: DataFrame, spatial: DataFrame, adjacency: DataFrame) -> dict[str, DataFrame]:
    """The stage tables of the spatial job, for debugging: candidates with
    their four neighbours, then with the count in the first one, two, three and
    four neighbours (null where unseen), then with nulls as 0. ``spatial`` is
    ``spatial_appearance`` of the same ``counts``."""
    keys = [c for c in (S.HW_TIME_FILTER, S.SUBSCRIBER_ID, S.INDEX_1KM) if c in counts.columns]
    near = unique_adjacency(adjacency)
    joined = (counts.join(near, counts[S.INDEX_1KM] == near["_cell"], "left")
              .select(*keys, S.APPEARANCE_COUNT,
                      *[F.get("_neighbours", F.lit(i)).alias(s) for i, s in enumerate(S.ADJ_SLOTS)]))
    found = spatial.select(*[F.col(k).alias(f"_{k}") for k in keys], *SLOT_COUNTS)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    full = joined.join(found, same).drop(*[f"_{k}" for k in keys])
    tables = {"appearanceJoinedAdjacentCell": joined}
    for upto in range(1, len(SLOT_COUNTS) + 1):
        tables[f"adj_{upto}"] = full.select(
            *joined.columns, *[F.nullif(F.col(c), F.lit(0)).alias(c) for c in SLOT_COUNTS[:upto]])
    return tables | {"na_filled": full}
