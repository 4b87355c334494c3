import datetime as dt

from cellscope.sources import demo


def test_cell_from_props_any_layout(spark):
    ev = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 8), 7, '{"k": 69}'),
         (2, dt.datetime(2024, 1, 1, 9), 7, '{"x": {"k": 3}, "k": 27}'),
         (3, dt.datetime(2024, 1, 1, 10), 7, ' { "k" : 5 , "y": 1}'),
         (4, dt.datetime(2024, 1, 1, 11), 7, '{"y": 1}')],
        "event_id long, ts timestamp_ntz, user_id long, props string")
    got = [r.INDEX_1KM for r in demo.cdr_from_events(ev).orderBy("CALL_TIME").collect()]
    assert got == ["19", "2", "5", None]


def test_grid_adjacency(spark):
    nation = spark.createDataFrame([(k,) for k in range(25)], "n_nationkey int")
    adj = {r.ADJ_INDEX_1KM: tuple(r)[1:] for r in demo.adjacency_from_nations(nation).collect()}
    assert adj["0"] == (None, "5", None, "1")
    assert adj["12"] == ("7", "17", "11", "13")
    assert adj["24"] == ("19", None, "23", None)
