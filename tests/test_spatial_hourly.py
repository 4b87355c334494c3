import pytest

from cellscope.operators import (hourly_cell_counts, hourly_top_cell, hourly_trajectory,
                                 spatial_appearance, spatial_stages, top_location)
from conftest import rows

SLOTS = ["ADJ_1_APPEARANCE_COUNT", "ADJ_2_APPEARANCE_COUNT", "ADJ_3_APPEARANCE_COUNT",
         "ADJ_4_APPEARANCE_COUNT"]


def test_spatial_neighbours_lift_b_over_a(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "A", 4), ("HOME_HOUR", "u", "B", 3), ("HOME_HOUR", "u", "C", 3)])
    adj = adjacency_df([("A", None, None, None, None), ("B", "C", None, None, None),
                        ("C", None, None, "B", None)])
    sp = spatial_appearance(c, adj)
    got = {r.INDEX_1KM: r.APPEARANCE_COUNT for r in sp.collect()}
    assert got == {"A": 4.0, "B": 4.5, "C": 4.5}
    assert [r.INDEX_1KM for r in top_location(sp).collect()] == ["B"]
    assert dict(sp.dtypes)["APPEARANCE_COUNT"] == "double"
    b = [r for r in sp.collect() if r.INDEX_1KM == "B"][0]
    assert [b[s] for s in SLOTS] == [3, 0, 0, 0] and b.ADJ_APPEARANCE == 3


def test_spatial_unvisited_neighbour_is_no_candidate(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "A", 2)])
    adj = adjacency_df([("A", "X", None, None, None), ("X", "A", None, None, None)])
    assert rows(spatial_appearance(c, adj), "INDEX_1KM", "APPEARANCE_COUNT") == [("A", 2.0)]


def test_spatial_cell_without_adjacency_row(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "Q", 2), ("HOME_HOUR", "u", None, 1)])
    adj = adjacency_df([("A", "Q", None, None, None)])
    assert rows(spatial_appearance(c, adj), "INDEX_1KM", "ADJ_APPEARANCE", "APPEARANCE_COUNT") == \
        [("Q", 0, 2.0), (None, 0, 1.0)]


def test_spatial_repeated_slot_counts_twice(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "A", 1), ("HOME_HOUR", "u", "B", 2)])
    adj = adjacency_df([("A", "B", None, "B", None)])
    a = [r for r in spatial_appearance(c, adj).collect() if r.INDEX_1KM == "A"][0]
    assert (a.ADJ_1_APPEARANCE_COUNT, a.ADJ_3_APPEARANCE_COUNT, a.ADJ_APPEARANCE, a.APPEARANCE_COUNT) == \
        (2, 2, 4, 3.0)


def test_spatial_repeated_adjacency_row_fails(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "A", 4), ("HOME_HOUR", "u", "B", 3)])
    adj = adjacency_df([("A", "B", None, None, None), ("A", "B", None, None, None)])
    with pytest.raises(Exception, match="more than one row for cell A"):
        spatial_appearance(c, adj).collect()


def test_spatial_null_subscriber_earns_no_credit(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", None, "A", 4), ("HOME_HOUR", None, "B", 3)])
    adj = adjacency_df([("A", "B", None, None, None), ("B", "A", None, None, None)])
    assert rows(spatial_appearance(c, adj), "INDEX_1KM", "APPEARANCE_COUNT") == [("A", 4.0), ("B", 3.0)]


def test_spatial_placeholder_neighbour_shared_by_all_border_cells(counts_df, adjacency_df):
    # Every cell names "0"; each row still asks at most four times.
    cells = [f"c{i}" for i in range(60)]
    c = counts_df([("HOME_HOUR", f"u{i % 7}", x, i + 1) for i, x in enumerate(cells)]
                  + [("HOME_HOUR", f"u{k}", "0", 10 * k + 1) for k in range(7)])
    adj = adjacency_df([(x, "0", "0", cells[i - 1], None) for i, x in enumerate(cells)])
    got = {(r.SUBSCRIBER_ID, r.INDEX_1KM): r for r in spatial_appearance(c, adj).collect()}
    assert len(got) == 67
    for i, x in enumerate(cells):
        placeholder = 10 * (i % 7) + 1
        r = got[f"u{i % 7}", x]
        assert (r.ADJ_1_APPEARANCE_COUNT, r.ADJ_2_APPEARANCE_COUNT, r.ADJ_3_APPEARANCE_COUNT) == \
            (placeholder, placeholder, 0)
        assert r.APPEARANCE_COUNT == i + 1 + placeholder


def test_spatial_stages(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "A", 4), ("HOME_HOUR", "u", "B", 3), ("HOME_HOUR", None, None, 1)])
    adj = adjacency_df([("A", "B", "X", None, None)])
    stages = spatial_stages(c, spatial_appearance(c, adj), adj)
    assert list(stages) == ["appearanceJoinedAdjacentCell", "adj_1", "adj_2", "adj_3", "adj_4", "na_filled"]
    assert rows(stages["adj_2"], "INDEX_1KM", "ADJ_1", "ADJ_1_APPEARANCE_COUNT", "ADJ_2_APPEARANCE_COUNT") == \
        [("A", "B", 3, None), ("B", None, None, None), (None, None, None, None)]
    assert rows(stages["na_filled"], "INDEX_1KM", *SLOTS) == [("A", 3, 0, 0, 0), ("B", 0, 0, 0, 0), (None, 0, 0, 0, 0)]


def test_spatial_keeps_classes_and_subscribers_apart(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "A", 1), ("WORK_HOUR", "u", "B", 5), ("HOME_HOUR", "v", "B", 7)])
    adj = adjacency_df([("A", "B", None, None, None)])
    a = [r for r in spatial_appearance(c, adj).collect() if r.INDEX_1KM == "A"][0]
    assert a.ADJ_APPEARANCE == 0


def test_spatial_weight_zero_equals_plain(counts_df, adjacency_df):
    c = counts_df([("HOME_HOUR", "u", "A", 4), ("HOME_HOUR", "u", "B", 3)])
    adj = adjacency_df([("A", "B", None, None, None), ("B", "A", None, None, None)])
    sp = spatial_appearance(c, adj, weight=0.0)
    assert rows(sp, "INDEX_1KM", "APPEARANCE_COUNT") == [("A", 4.0), ("B", 3.0)]


def test_hourly_trajectory(cdr):
    df = cdr([("u", "20130110080000", "X"), ("u", "20130110081500", "X"), ("u", "20130110083000", "Y"),
              ("u", "20130110100000", "Z"), ("v", "20130111080000", "X")])
    traj = hourly_trajectory(hourly_top_cell(hourly_cell_counts(df, 2013, 10)))
    assert traj.columns == ["SUBSCRIBER_ID"] + [str(h) for h in range(24)]
    r = traj.collect()
    assert len(r) == 1 and r[0]["8"] == "X" and r[0]["9"] is None and r[0]["10"] == "Z"


def test_hourly_tie_smallest_cell(cdr):
    df = cdr([("u", "20130110080000", "Y"), ("u", "20130110081500", "X")])
    top = hourly_top_cell(hourly_cell_counts(df, 2013, 10))
    assert rows(top) == [("u", "X", 8)]
