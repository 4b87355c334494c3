"""End-to-end jobs on a data folder laid out like the original one, built
from the driver's sf0.001 tables."""

import os

import pytest
from pyspark.sql import functions as F

from cellscope import schemas as S
from cellscope.plans import jobs, registry
from cellscope.session import scratch_dir
from cellscope.sinks import read_csv
from cellscope.sources import demo
from conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data_root(spark):
    root = scratch_dir(spark, "jobs").removeprefix("file:")
    raw = demo.cdr_from_events(demo.load(spark, SF, "events"))
    first = F.col(S.CALL_TIME) < F.lit("20240116000000")
    raw.filter(first).repartition(2).write.parquet(f"{root}/{jobs.CDR_DIRS[0]}")
    raw.filter(~first).repartition(2).write.parquet(f"{root}/{jobs.CDR_DIRS[1]}")
    raw.repartition(2).write.parquet(f"{root}/synv_20130601_20131201")
    registry.adjacency(spark, SF).coalesce(1).write.csv(f"{root}/adj")
    [part] = [f for f in os.listdir(f"{root}/adj") if f.startswith("part-")]
    os.link(f"{root}/adj/{part}", f"{root}/{jobs.ADJACENCY_FILE}")
    cells = registry.cells(spark, SF)
    cells.select(S.LOCATION_ID, S.LATITUDE, S.LONGITUDE).write.option("header", True).csv(
        f"{root}/1KM_CELL_CENTRES.csv")
    cells.write.option("header", True).csv(f"{root}/1K_CELL_CENTERS_ALL.CSV")
    return root


def test_home_work_job(spark, data_root):
    res = jobs.home_work_job(spark, data_root, version="v1", weeks=None)
    want = rows(registry.QUERIES["home_work_joined"](spark, SF))
    assert rows(res["home_work"]) == want
    out = f"{data_root}/output/tc/v1"
    back = read_csv(spark, f"{out}/homeWorkJoined.csv",
                    {"HOME_APPEARANCE_COUNT": "bigint", "WORK_APPEARANCE_COUNT": "bigint"})
    assert rows(back) == want
    home = read_csv(spark, f"{out}/homeYear/subscriberLocationByCellId.csv")
    assert home.columns == ["SUBSCRIBER_ID", "INDEX_1KM", "MAX_APPEARANCE_COUNT"]
    counts = read_csv(spark, f"{out}/workYear/locationSubscriberCount.csv", {"COUNT_IN_1KM_CELL": "bigint"})
    assert counts.agg(F.sum("COUNT_IN_1KM_CELL")).first()[0] == home.count()
    with pytest.raises(Exception):          # a rerun of the same version must not overwrite
        jobs.home_work_job(spark, data_root, version="v1", weeks=None)


def test_home_work_job_ties_kept(spark, data_root):
    res = jobs.home_work_job(spark, data_root, version="t1", weeks=None, one_per_subscriber=False)
    want = rows(registry.QUERIES["home_work_with_ties"](spark, SF))
    back = read_csv(spark, f"{data_root}/output/tc/t1/homeWorkJoined.csv",
                    {"HOME_APPEARANCE_COUNT": "bigint", "WORK_APPEARANCE_COUNT": "bigint"})
    assert rows(back) == want
    assert rows(res["home_work"]) == want


def test_spatial_home_work_job(spark, data_root):
    res = jobs.home_work_job(spark, data_root, version="s1", spatial=True, weeks=None, debug=True)
    assert rows(res["home_work"]) == rows(registry.QUERIES["spatial_home_work"](spark, SF))
    assert sorted(os.listdir(f"{data_root}/output/sc/s1/debug")) == \
        ["adj_1", "adj_2", "adj_3", "adj_4", "appearanceJoinedAdjacentCell", "na_filled"]


def test_residents_map_job(spark, data_root):
    res = jobs.residents_map_job(spark, data_root)
    want = registry.QUERIES["residents_map"](spark, SF)
    got = res[S.HOME_HOUR].withColumn(S.HW_TIME_FILTER, F.lit(S.HOME_HOUR)).unionByName(
        res[S.WORK_HOUR].withColumn(S.HW_TIME_FILTER, F.lit(S.WORK_HOUR)))
    assert rows(got, *want.columns) == rows(want)
    assert os.path.isdir(f"{data_root}/output/homeRecidentCount.csv")
    assert read_csv(spark, f"{data_root}/output/HomeYearOutput.csv").columns == \
        ["SUBSCRIBER_ID", "INDEX_1KM", "MAX_APEARENCE_COUNT"]


def test_hourly_job(spark, data_root):
    traj = jobs.hourly_trajectory_job(spark, data_root, version=1, year=2024, day_of_year=10)
    assert rows(traj) == rows(registry.QUERIES["hourly_trajectory"](spark, SF))
    assert os.path.isdir(f"{data_root}/output/SimMobility/1/2024_10")


def test_regional_sample_job(spark, data_root):
    from cellscope.plans import params as P
    sample = jobs.regional_sample_job(spark, data_root, province=P.PROVINCE,
                                      start=P.PERIOD_START, end=P.PERIOD_END,
                                      n_users=P.SAMPLE_USERS, seed=P.SAMPLE_SEED)
    assert rows(sample) == rows(registry.QUERIES["user_sample"](spark, SF))
    assert os.path.isdir(f"{data_root}/output/SampleUserFor{P.PROVINCE}.csv")


def test_unreadable_files_job(spark, data_root):
    d = f"{data_root}/{jobs.CDR_DIRS[0]}"
    open(f"{d}/zz-empty.parquet", "wb").close()
    bad = jobs.unreadable_files_job(spark, data_root, version=3)
    assert [os.path.basename(r.FAILED_FILES) for r in bad.collect()] == ["zz-empty.parquet"]
