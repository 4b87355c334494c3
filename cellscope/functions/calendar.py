"""Column expressions for call times and calendar fields.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; nothing here runs Python per row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Fixed value: layout of CALL_TIME text.
CALL_TIME_FORMAT = "%Y%m%d%H%M%S"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_digit(ch: Column) -> Column:
    return (ch >= F.lit("0")) & (ch <= F.lit("9"))


def parse_call_time(call_time: Column | str = S.CALL_TIME) -> Column:
    """``yyyyMMddHHmmss`` text to a zone-less ``TIMESTAMP_NTZ``.

    The first five fields are 12 digits; the seconds are all digits that
    follow (the last field of the legacy parser takes what there is), so 13
    digits have a one-digit second and 17 (milliseconds) a second over 59.
    Text after the digits is ignored; anything that is not a real date and
    time (month 13, 30 February, hour 24, second 567, short text, signs, null)
    becomes null instead of failing the query under ANSI mode. The value is
    built from its fields, so it never depends on the session time zone (no
    DST gaps).

    The usual 14 digits are checked as: length 14, first and last characters
    digits, no digit after them, and the whole text a valid integer (which then
    cannot hold a sign, a blank, a dot or an exponent); cheaper than the
    regular expression that the other texts go through.
    """
    whole = _col(call_time)
    s = F.substring(whole, 1, 14)
    fourteen_digits = ((F.length(s) == 14) & _is_digit(F.substring(s, 1, 1))
                       & _is_digit(F.substring(s, 14, 1)) & ~_is_digit(F.substring(whole, 15, 1))
                       & s.try_cast("bigint").isNotNull())

    def field(pos: int, n: int) -> Column:
        return F.substring(s, pos, n).try_cast("int")

    seconds = F.when(fourteen_digits, field(13, 2)).otherwise(
        F.regexp_extract(whole, r"^[0-9]{12}[ \t]*([0-9]+)", 1).try_cast("int"))
    return F.when(seconds <= 59,
                  F.try_make_timestamp_ntz(field(1, 4), field(5, 2), field(7, 2),
                                           field(9, 2), field(11, 2), seconds))


def us_week_of_year(ts: Column | str) -> Column:
    """Week of year under the US rule: weeks start on Sunday and week 1 is
    the week holding 1 January, so the last days of December can be week 1.

    The week is numbered by the Saturday that ends it (the first Saturday
    on or after the date): that Saturday's day of year divided by 7,
    rounded up. (ISO ``weekofyear`` is a different rule.)
    """
    saturday = F.next_day(F.date_sub(F.to_date(_col(ts)), 1), "Sat")
    return F.ceil(F.dayofyear(saturday) / F.lit(7)).cast("int")


def enrich(raw: "DataFrame", with_year: bool = True) -> "DataFrame":  # noqa: F821
    """Raw CDR (SUBSCRIBER_ID, CALL_TIME, INDEX_1KM) to the enriched form
    with the parsed timestamp and the four calendar columns.

    The time is parsed once per row inside a one-row generator. Without it,
    a later filter on a calendar column (week range, hour class, day) is
    pushed below this projection with the parse expression substituted for
    every reference, so each row is parsed several times; a generator's
    output cannot be substituted, so filters read the parsed value.
    Filters on SUBSCRIBER_ID / INDEX_1KM still reach the scan.
    """
    parsed = raw.select(
        S.SUBSCRIBER_ID, S.INDEX_1KM,
        F.inline(F.array(F.struct(parse_call_time(S.CALL_TIME).alias(S.CALL_TIMESTAMP)))))
    ts = F.col(S.CALL_TIMESTAMP)
    derived = [F.year(ts).alias(S.YEAR)] if with_year else []
    derived += [us_week_of_year(ts).alias(S.WEEK_OF_YEAR),
                F.dayofyear(ts).alias(S.DATE_OF_YEAR),
                F.hour(ts).alias(S.HOUR_OF_DAY)]
    return parsed.select(S.SUBSCRIBER_ID, S.CALL_TIMESTAMP, S.INDEX_1KM, *derived)


def call_time_range(start: dt.datetime, end_exclusive: dt.datetime,
                    call_time: Column | str = S.CALL_TIME) -> Column:
    """Text range on raw CALL_TIME equivalent to ``start <= t < end`` for every
    value that parses (the 14-digit prefix sorts like the time it encodes).

    The calendar filter on the parsed time cannot reach the Parquet reader;
    this one can, so row groups outside the period are skipped. It is always
    used together with the exact filter, never instead of it.
    """
    c = _col(call_time)
    return (c >= F.lit(start.strftime(CALL_TIME_FORMAT))) & \
           (c < F.lit(end_exclusive.strftime(CALL_TIME_FORMAT)))


def day_bounds(year: int, day_of_year: int) -> tuple[dt.datetime, dt.datetime]:
    """[start, end) of one calendar day given as year and day of year."""
    start = dt.datetime(year, 1, 1) + dt.timedelta(days=day_of_year - 1)
    return start, start + dt.timedelta(days=1)
