"""The registered queries: each builds its plan from the driver's tables
(``events``, ``nation``, ``region``) under ``sf_dir`` through the library's
sources and operators. Keys match ``oracle.oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..functions.calendar import day_bounds, enrich
from ..functions.classify import hour_class
from ..operators import (appearance_counts, cells_as_text, daily_presence, home_work,
                         hourly_cell_counts, hourly_top_cell, hourly_trajectory,
                         oversized_ids, regional_records, residents_map,
                         residents_per_cell, spatial_appearance, top_location, user_sample)
from ..sources import demo
from ..sources.cdr import week_range
from . import fixtures
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]


def cdr(spark: SparkSession, sf_dir: str, period=None) -> DataFrame:
    """Enriched CDR mapped from ``events``."""
    return enrich(demo.cdr_from_events(demo.load(spark, sf_dir, "events"), period))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearance_counts(daily_presence(cdr(spark, sf_dir)))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.adjacency_from_nations(demo.load(spark, sf_dir, "nation"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.cells_from_nations(demo.load(spark, sf_dir, "nation"),
                                   demo.load(spark, sf_dir, "region"))


def spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_appearance(counts(spark, sf_dir), adjacency(spark, sf_dir))


def hourly_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = cdr(spark, sf_dir, period=day_bounds(P.HOURLY_YEAR, P.HOURLY_DAY))
    return hourly_top_cell(hourly_cell_counts(day, P.HOURLY_YEAR, P.HOURLY_DAY))


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The exact filter is CALL_TIMESTAMP <= end; the pushed-down one is ts < end + 1 s.
    period = (P.PERIOD_START, P.PERIOD_END + fixtures.ONE_SECOND)
    return regional_records(cdr(spark, sf_dir, period=period), cells(spark, sf_dir),
                            P.PROVINCE, P.PERIOD_START, P.PERIOD_END)


def _hour_class(spark, sf_dir):
    return cdr(spark, sf_dir).select(S.SUBSCRIBER_ID, S.CALL_TIMESTAMP, S.INDEX_1KM,
                                     S.HOUR_OF_DAY, hour_class().alias(S.HW_TIME_FILTER))


QUERIES: dict[str, Query] = {
    "cdr_enriched": cdr,
    "cdr_week_range": lambda spark, d: week_range(cdr(spark, d), P.WEEKS),
    "hour_class": _hour_class,
    "daily_presence": lambda spark, d: daily_presence(cdr(spark, d)),
    "appearance_counts": counts,
    "top_locations_with_ties": lambda spark, d: top_location(counts(spark, d), False),
    "top_location": lambda spark, d: top_location(counts(spark, d)),
    "residents_per_cell": lambda spark, d: residents_per_cell(top_location(counts(spark, d))),
    "home_work_joined": lambda spark, d: home_work(top_location(counts(spark, d))),
    # Tied cells as sorted arrays, rendered as text for a stable comparison.
    "home_work_with_ties": lambda spark, d: cells_as_text(
        home_work(top_location(counts(spark, d), False), False)),
    "spatial_appearance": spatial,
    "spatial_top_location": lambda spark, d: top_location(spatial(spark, d)),
    "spatial_home_work": lambda spark, d: home_work(top_location(spatial(spark, d))),
    "hourly_cell_counts": lambda spark, d: hourly_cell_counts(
        cdr(spark, d, period=day_bounds(P.HOURLY_YEAR, P.HOURLY_DAY)), P.HOURLY_YEAR, P.HOURLY_DAY),
    "hourly_top_cell": hourly_top,
    "hourly_trajectory": lambda spark, d: hourly_trajectory(hourly_top(spark, d)),
    "residents_map": lambda spark, d: residents_map(
        residents_per_cell(top_location(counts(spark, d), False)),
        demo.centres_from_nations(demo.load(spark, d, "nation"), demo.load(spark, d, "region"))),
    "regional_records": regional,
    "user_sample": lambda spark, d: user_sample(regional(spark, d), P.SAMPLE_USERS, P.SAMPLE_SEED),
    "oversized_ids": lambda spark, d: oversized_ids(
        demo.cdr_from_events(demo.load(spark, d, "events")), P.OVERSIZE_LENGTH),
    "csv_round_trip": fixtures.csv_round_trip,
    "adjacency_source": fixtures.adjacency_source,
    "cells_source": fixtures.cells_source,
    "csv_single_file": fixtures.csv_single_file,
    "csv_versioned": fixtures.csv_versioned,
    "spatial_stages": fixtures.spatial_stages,
    "cdr_excluding_files": fixtures.cdr_excluding_files,
    "unreadable_files": fixtures.unreadable_files,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
