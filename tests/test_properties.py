"""Properties over the driver's sf0.001 tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellscope import schemas as S
from cellscope.operators import (appearance_counts, daily_presence, home_work, hourly_cell_counts,
                                 residents_per_cell, spatial_appearance, top_location)
from cellscope.plans import params as P
from cellscope.plans import registry as R
from conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counts(spark):
    return R.counts(spark, SF).cache()


def test_one_per_subscriber_is_subset_of_ties(counts):
    one = set(rows(top_location(counts)))
    ties = set(rows(top_location(counts, one_per_subscriber=False)))
    assert one <= ties and len(one) == len({(r[0], r[1]) for r in ties})


def test_residents_sum_to_located_subscribers(counts):
    loc = top_location(counts)
    total = residents_per_cell(loc).agg(F.sum(S.COUNT_IN_1KM_CELL)).first()[0]
    assert total == loc.count()


def test_spatial_total_at_least_plain(spark, counts):
    sp = spatial_appearance(counts, R.adjacency(spark, SF))
    j = sp.join(counts.withColumnRenamed(S.APPEARANCE_COUNT, "plain"),
                [S.HW_TIME_FILTER, S.SUBSCRIBER_ID, S.INDEX_1KM])
    assert j.count() == counts.count() == sp.count()
    assert j.filter(F.col(S.APPEARANCE_COUNT) < F.col("plain")).count() == 0
    flat = spatial_appearance(counts, R.adjacency(spark, SF), weight=0.0)
    assert flat.filter(F.col(S.APPEARANCE_COUNT) != F.col(S.APPEARANCE_COUNT).cast("bigint")).count() == 0


def test_trajectory_cell_seen_that_hour(spark):
    cdr = R.cdr(spark, SF)
    top = R.hourly_top(spark, SF)
    seen = hourly_cell_counts(cdr, P.HOURLY_YEAR, P.HOURLY_DAY).select(
        S.SUBSCRIBER_ID, S.HOUR_OF_DAY, S.INDEX_1KM)
    assert top.join(seen, [S.SUBSCRIBER_ID, S.HOUR_OF_DAY, S.INDEX_1KM], "left_anti").count() == 0


@pytest.mark.parametrize("name", ["home_work_joined", "spatial_home_work", "hourly_trajectory",
                                  "user_sample", "top_locations_with_ties"])
def test_independent_of_partition_count(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = rows(R.QUERIES[name](spark, SF))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = rows(R.QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) > 0


def test_presence_by_year_never_smaller(spark):
    cdr = R.cdr(spark, SF)
    assert daily_presence(cdr, by_year=True).count() >= daily_presence(cdr).count()
    assert appearance_counts(daily_presence(cdr)).count() > 0


_classes = st.sampled_from(["HOME_HOUR", "WORK_HOUR"])
_count_tables = st.dictionaries(
    st.tuples(_classes, st.sampled_from(["u", "v", "w", None]), st.sampled_from(["a", "b", "c", None])),
    st.integers(min_value=1, max_value=3), min_size=1, max_size=14)


def _brute_force_pairs(table):
    """The original merge: argmax ties per (class, subscriber), then a full
    outer join of the home and the work side on the subscriber."""
    ties = {}
    for (cls, sub, cell), n in table.items():
        if sub is None:
            continue
        best = max(v for (c, s, _), v in table.items() if c == cls and s == sub)
        if n == best:
            ties.setdefault((cls, sub), []).append((cell, n))
    out = []
    for sub in {s for (_, s) in ties}:
        home = ties.get(("HOME_HOUR", sub), [(None, None)])
        work = ties.get(("WORK_HOUR", sub), [(None, None)])
        out += [(sub, h, hn, w, wn) for h, hn in home for w, wn in work]
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(table=_count_tables)
def test_factored_ties_expand_to_the_pairs(counts_df, table):
    from test_presence_location import _pairs

    c = counts_df([(cls, sub, cell, n) for (cls, sub, cell), n in table.items()])
    got = rows(home_work(top_location(c, one_per_subscriber=False), one_per_subscriber=False))
    assert _pairs(got) == _brute_force_pairs(table)
