import datetime as dt

from pyspark.sql import functions as F

from cellscope.functions import hour_class, parse_call_time, us_week_of_year
from cellscope.functions.calendar import call_time_range, day_bounds


def test_hour_class_edges(spark):
    df = spark.createDataFrame([(h,) for h in (0, 4, 5, 20, 21, 23, None)], "h int")
    got = [r.c for r in df.select(hour_class("h").alias("c")).collect()]
    assert got == ["HOME_HOUR", "HOME_HOUR", "WORK_HOUR", "WORK_HOUR", "HOME_HOUR", "HOME_HOUR", ""]


def test_us_week_edges(spark):
    days = ["2012-12-01", "2012-12-30", "2013-01-01", "2013-11-30", "2013-12-29"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = [r.w for r in df.select(us_week_of_year(F.to_date("d")).alias("w")).collect()]
    assert got == [48, 1, 1, 48, 1]


def test_us_week_matches_rule_over_years(spark):
    # Brute force: week = 1 + number of Sundays after 1 Jan up to the date.
    start = dt.date(2011, 1, 1)
    dates = [start + dt.timedelta(days=i) for i in range(365 * 4)]

    def rule(d):
        sat = d + dt.timedelta(days=(5 - d.weekday()) % 7)   # Saturday ending the week
        return (sat.timetuple().tm_yday + 6) // 7
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    got = {r.d: r.w for r in df.select("d", us_week_of_year("d").alias("w")).collect()}
    assert all(got[d] == rule(d) for d in dates)


def test_parse_edges(spark):
    vals = ["20130101123456", "20130101123456abc", "2013010112", "bad", None,
            "20131301000000", "20130230000000", "20130101240000",
            # The seconds are all digits from the 13th on.
            "2013010112345", "2013010112345x", "201301011234012", "201301011234567", "20130101123456789",
            "201301011234 5", "20130101123460", "201301011234", "+2013010112345", ""]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.t for r in df.select(parse_call_time("s").alias("t")).collect()]
    want = dt.datetime(2013, 1, 1, 12, 34, 56)
    five, twelve = want.replace(second=5), want.replace(second=12)
    assert got == [want, want, None, None, None, None, None, None,
                   five, five, twelve, None, None, five, None, None, None, None]
    assert dict(df.select(parse_call_time("s").alias("t")).dtypes)["t"] == "timestamp_ntz"


def test_parse_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # 02:30 on 10 March 2013 does not exist in New York; the text has no zone.
        df = spark.createDataFrame([("20130310023000",)], "s string")
        assert df.select(parse_call_time("s").alias("t")).first().t == dt.datetime(2013, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_call_time_range_and_day_bounds(spark):
    start, end = day_bounds(2013, 317)
    assert start == dt.datetime(2013, 11, 13) and end == dt.datetime(2013, 11, 14)
    df = spark.createDataFrame([(v,) for v in ["20131112235959", "20131113000000",
                                               "20131113235959xyz", "20131114000000"]], "s string")
    got = [r.s for r in df.filter(call_time_range(start, end, "s")).collect()]
    assert got == ["20131113000000", "20131113235959xyz"]


def test_enrich_columns(cdr):
    df = cdr([("u1", "20130101123456", "c1"), ("u2", "garbage", "c2")])
    assert df.columns == ["SUBSCRIBER_ID", "CALL_TIMESTAMP", "INDEX_1KM", "YEAR",
                          "WEEK_OF_YEAR", "DATE_OF_YEAR", "HOUR_OF_DAY"]
    r = {x.SUBSCRIBER_ID: x for x in df.collect()}
    assert (r["u1"].YEAR, r["u1"].WEEK_OF_YEAR, r["u1"].DATE_OF_YEAR, r["u1"].HOUR_OF_DAY) == (2013, 1, 1, 12)
    assert r["u2"].CALL_TIMESTAMP is None and r["u2"].HOUR_OF_DAY is None
