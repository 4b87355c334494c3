"""Call-detail-record sources."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.calendar import call_time_range, enrich
from .files import canonical_path


def exclude_files(df: DataFrame, suffixes: Iterable[str]) -> DataFrame:
    """Drop the rows of files whose full path ends with any of ``suffixes``,
    written as the files are called (``a b+.parquet``, not ``a%20b+.parquet``).

    The predicate is on the hidden ``_metadata.file_path`` column, which
    Spark evaluates against the file listing, so an excluded file is pruned
    before it is opened: a corrupt file in the list never fails the scan.
    """
    suffixes = [s for s in suffixes if s]
    if not suffixes:
        return df
    path = canonical_path()
    bad = F.lit(False)
    for s in suffixes:
        bad = bad | path.endswith(s)
    return df.filter(~bad)


def read_raw_cdr(spark: SparkSession, paths: str | Sequence[str],
                 exclude: Iterable[str] = (),
                 period: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame:
    """Raw CDR (SUBSCRIBER_ID, CALL_TIME, INDEX_1KM) from one or more
    directories of Parquet files, with the fixed CDR schema (no footer
    inference across thousands of files).

    ``period`` = [start, end) adds a text-range predicate on CALL_TIME that
    Parquet can use to skip row groups; callers keep their exact filter.
    """
    if isinstance(paths, str):
        paths = [paths]
    raw = (spark.read.schema(S.CDR)
           .option("pathGlobFilter", "*.parquet")
           .parquet(*paths))
    raw = exclude_files(raw, exclude)
    if period is not None:
        raw = raw.filter(call_time_range(*period))
    return raw.select(S.SUBSCRIBER_ID, S.CALL_TIME, S.INDEX_1KM)


def read_cdr(spark: SparkSession, paths: str | Sequence[str],
             exclude: Iterable[str] = (), weeks: tuple[int, int] | None = None,
             period: tuple[dt.datetime, dt.datetime] | None = None,
             with_year: bool = True) -> DataFrame:
    """Enriched CDR: SUBSCRIBER_ID, CALL_TIMESTAMP, INDEX_1KM, YEAR,
    WEEK_OF_YEAR, DATE_OF_YEAR, HOUR_OF_DAY.

    ``weeks`` = (first, last) keeps US weeks in that inclusive range; rows
    with an unparseable time have a null week and drop out.
    """
    df = enrich(read_raw_cdr(spark, paths, exclude, period), with_year=with_year)
    return week_range(df, weeks)


def week_range(cdr: DataFrame, weeks: tuple[int, int] | None) -> DataFrame:
    """Keep weeks ``first..last`` inclusive (None keeps everything)."""
    if weeks is None:
        return cdr
    first, last = weeks
    return cdr.filter(F.col(S.WEEK_OF_YEAR).between(first, last))
