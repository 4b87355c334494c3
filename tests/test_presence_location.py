from pyspark.sql import functions as F

from cellscope import schemas as S
from cellscope.operators import (appearance_counts, cells_as_text, daily_presence, home_work,
                                 merge_home_work, residents_map, residents_per_cell,
                                 top_location)
from conftest import rows


def test_daily_presence_one_row_per_day(cdr):
    df = cdr([("u", "20130105100000", "c"), ("u", "20130105120000", "c"), ("u", "20130105150000", "c")])
    assert daily_presence(df).count() == 1


def test_midnight_counts_two_home_days(cdr):
    df = cdr([("u", "20130105230000", "c"), ("u", "20130106010000", "c")])
    got = rows(appearance_counts(daily_presence(df)))
    assert got == [("HOME_HOUR", "u", "c", 2)]


def test_year_collapse(cdr):
    # 2012-01-05 and 2013-01-05: same day of year (5); US weeks 1 and 1.
    df = cdr([("u", "20120105100000", "c"), ("u", "20130105100000", "c")])
    assert daily_presence(df).count() == 1
    assert daily_presence(df, by_year=True).count() == 2


def test_null_hour_class_is_empty_and_not_counted(cdr):
    df = cdr([("u", "bad", "c"), ("u", "20130105100000", "c")])
    p = daily_presence(df)
    assert sorted(r.HW_TIME_FILTER for r in p.collect()) == ["", "WORK_HOUR"]
    assert rows(appearance_counts(p)) == [("WORK_HOUR", "u", "c", 1)]


def test_tie_smallest_cell_and_ties_kept(counts_df):
    c = counts_df([("HOME_HOUR", "u", "b", 3), ("HOME_HOUR", "u", "a", 3), ("HOME_HOUR", "u", "z", 1)])
    assert rows(top_location(c)) == [("HOME_HOUR", "u", "a", 3)]
    assert rows(top_location(c, one_per_subscriber=False)) == [("HOME_HOUR", "u", "a", 3),
                                                              ("HOME_HOUR", "u", "b", 3)]


def test_null_cell_wins_and_drops_in_map(spark, counts_df):
    c = counts_df([("HOME_HOUR", "u", None, 5), ("HOME_HOUR", "u", "a", 2), ("HOME_HOUR", "v", "a", 1)])
    loc = top_location(c)
    assert rows(loc, "SUBSCRIBER_ID", "INDEX_1KM") == [("u", None), ("v", "a")]
    res = residents_per_cell(loc)
    assert rows(res, "LOCATION_ID", "COUNT_IN_1KM_CELL") == [("a", 1), (None, 1)]
    centres = spark.createDataFrame([("a", "6.9", "79.8")], S.CENTRES)
    assert rows(residents_map(res, centres), "LOCATION_ID", "COUNT_IN_1KM_CELL") == [("a", 1)]


def test_null_subscriber_absent(counts_df):
    c = counts_df([("HOME_HOUR", None, "a", 9), ("HOME_HOUR", "u", "a", 1)])
    assert [r.SUBSCRIBER_ID for r in top_location(c).collect()] == ["u"]


def test_home_only_and_work_only(counts_df):
    c = counts_df([("HOME_HOUR", "h", "a", 2), ("WORK_HOUR", "w", "b", 3)])
    assert rows(home_work(top_location(c))) == [("h", "a", 2, None, None), ("w", None, None, "b", 3)]
    assert rows(cells_as_text(home_work(top_location(c)))) == rows(home_work(top_location(c)))
    assert rows(home_work(top_location(c), one_per_subscriber=False)) == [
        ("h", ["a"], 2, None, None), ("w", None, None, ["b"], 3)]


def _pairs(factored_rows):
    """The full-outer-join rows the factored form stands for."""
    out = []
    for sub, hc, hn, wc, wn in factored_rows:
        for h in (hc or [None]):
            for w in (wc or [None]):
                out.append((sub, h, hn if hc else None, w, wn if wc else None))
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_ties_on_both_sides_factored(counts_df):
    # The reference's full outer join gives home ties x work ties = 4 rows;
    # here one row lists both sides' ties, and expands to those 4 rows.
    c = counts_df([("HOME_HOUR", "u", "b", 2), ("HOME_HOUR", "u", "a", 2),
                   ("WORK_HOUR", "u", "d", 1), ("WORK_HOUR", "u", "c", 1)])
    out = home_work(top_location(c, one_per_subscriber=False), one_per_subscriber=False)
    assert out.columns == list(S.HOME_WORK_COLUMNS)
    got = rows(out)
    assert got == [("u", ["a", "b"], 2, ["c", "d"], 1)]
    assert _pairs(got) == [("u", "a", 2, "c", 1), ("u", "a", 2, "d", 1),
                           ("u", "b", 2, "c", 1), ("u", "b", 2, "d", 1)]
    assert rows(cells_as_text(out)) == [("u", "a,b", 2, "c,d", 1)]


def test_tied_null_cell_kept_last(counts_df):
    c = counts_df([("HOME_HOUR", "u", None, 2), ("HOME_HOUR", "u", "a", 2),
                   ("WORK_HOUR", "v", None, 1)])
    out = home_work(top_location(c, one_per_subscriber=False), one_per_subscriber=False)
    assert rows(out) == [("u", ["a", None], 2, None, None), ("v", None, None, [None], 1)]
    assert rows(cells_as_text(out)) == [("u", "a,\\N", 2, None, None), ("v", None, None, "\\N", 1)]


def test_tie_merge_has_no_join(counts_df):
    # No pair of rows is ever formed: the plan aggregates, it does not join.
    c = counts_df([("HOME_HOUR", "u", "a", 2), ("WORK_HOUR", "u", "c", 1)])
    out = home_work(top_location(c, one_per_subscriber=False), one_per_subscriber=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_merge_home_work_keep_ties(counts_df):
    c = counts_df([("HOME_HOUR", "u", "a", 2), ("HOME_HOUR", "u", "b", 2), ("WORK_HOUR", "u", "c", 1),
                   ("WORK_HOUR", "w", "d", 4)])
    loc = top_location(c, one_per_subscriber=False)
    h = loc.filter(F.col("HW_TIME_FILTER") == "HOME_HOUR").drop("HW_TIME_FILTER")
    w = loc.filter(F.col("HW_TIME_FILTER") == "WORK_HOUR").drop("HW_TIME_FILTER")
    assert rows(merge_home_work(h, w, keep_ties=True)) == [("u", ["a", "b"], 2, ["c"], 1),
                                                          ("w", None, None, ["d"], 4)]


def test_merge_home_work_generic(counts_df):
    c = counts_df([("HOME_HOUR", "u", "a", 2), ("WORK_HOUR", "u", "c", 1)])
    loc = top_location(c)
    h = loc.filter(F.col("HW_TIME_FILTER") == "HOME_HOUR").drop("HW_TIME_FILTER")
    w = loc.filter(F.col("HW_TIME_FILTER") == "WORK_HOUR").drop("HW_TIME_FILTER")
    assert rows(merge_home_work(h, w)) == [("u", "a", 2, "c", 1)]
