"""Versions of results appear whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from cellscope import schemas as S
from cellscope.plans import jobs
from cellscope.session import scratch_dir
from cellscope.sinks import read_csv, remove_stagings, versioned_path, versions, whole_version, whole_versions
from conftest import rows


HOME_WORK_COUNTS = {c: "bigint" for c in ("HOME_APPEARANCE_COUNT", "WORK_APPEARANCE_COUNT")}


@pytest.fixture
def root(spark):
    root = scratch_dir(spark, "test").removeprefix("file:")
    data = [(f"u{i % 7}", f"201301{1 + i % 28:02d}{i % 24:02d}0000", f"c{i % 5}") for i in range(600)]
    for folder in jobs.CDR_DIRS:
        spark.createDataFrame(data, S.CDR).write.parquet(f"{root}/{folder}")
    return root


def failing_at(number, seen, there):
    """A ``write_csv`` that notes what readers see and dies at this call."""
    def write(df, path, *args, **kwargs):
        seen.append(there())
        if len(seen) == number:
            raise KeyboardInterrupt("the job is killed")
        return real(df, path, *args, **kwargs)

    real = versions.write_csv
    return write


@pytest.mark.parametrize("number", [1, 3, 5])
def test_a_killed_job_leaves_nothing_and_a_rerun_succeeds(spark, root, monkeypatch, number):
    out, seen = versioned_path(root, "tc", "v1"), []
    with monkeypatch.context() as m:
        m.setattr(versions, "write_csv", failing_at(number, seen, lambda: os.path.exists(out)))
        with pytest.raises(KeyboardInterrupt):
            jobs.home_work_job(spark, root, version="v1")
    assert seen == [False] * number and not os.path.exists(out)
    assert whole_versions(spark, root, "tc") == {}
    result = jobs.home_work_job(spark, root, version="v1")
    assert result["home_work"].count() == 7
    assert sorted(n for n in os.listdir(out) if not n.startswith(".")) == ["_MANIFEST.json", "homeWorkJoined.csv", "homeYear", "workYear"]
    assert {k: len(v) for k, v in whole_versions(spark, root, "tc").items()} == {"v1": 5}


def test_overwrite_keeps_the_version_before_until_the_new_one_is_whole(spark, root, monkeypatch):
    first = rows(jobs.home_work_job(spark, root, version=1)["home_work"])
    with monkeypatch.context() as m:
        m.setattr(versions, "write_csv", failing_at(4, [], lambda: True))
        with pytest.raises(KeyboardInterrupt):
            jobs.home_work_job(spark, root, version=1, weeks=(1, 1), mode="overwrite")
    path = versioned_path(root, "tc", 1, jobs.HOME_WORK_CSV)
    assert rows(read_csv(spark, path, HOME_WORK_COUNTS)) == first
    second = rows(jobs.home_work_job(spark, root, version=1, weeks=(1, 1), mode="overwrite")["home_work"])
    assert second != first and rows(read_csv(spark, path, HOME_WORK_COUNTS)) == second
    assert not [n for n in os.listdir(os.path.dirname(os.path.dirname(path))) if n.startswith(versions.STAGING)]


def test_what_a_dead_process_left_is_never_seen(spark, root):
    # A process that dies at once runs no clean-up: only its hidden folder is left.
    hidden = versioned_path(root, "tc", ".staging-v1-dead")
    os.makedirs(f"{hidden}/homeYear")
    assert whole_versions(spark, root, "tc") == {}
    jobs.home_work_job(spark, root, version="v1")
    assert list(whole_versions(spark, root, "tc")) == ["v1"]
    remove_stagings(spark, root, "tc")
    assert not os.path.exists(hidden)
    # A folder without a manifest is no whole version (a store that copies).
    os.makedirs(versioned_path(root, "tc", "half"))
    assert list(whole_versions(spark, root, "tc")) == ["v1"]


def test_refusals(spark, root):
    df = spark.range(3).select(F.col("id").cast("string"))
    path = versioned_path(root, "x", 1)
    with whole_version(spark, path) as staged:
        staged.write_csv(df, "a")
    with pytest.raises(FileExistsError), whole_version(spark, path):
        raise AssertionError("must refuse before any work")
    with pytest.raises(ValueError), whole_version(spark, path, "append"):
        pass


def test_results_that_share_a_folder(spark, root):
    out = f"{root}/output"
    os.makedirs(f"{out}/other")
    df = spark.range(3).select(F.col("id").cast("string"))
    with pytest.raises(ZeroDivisionError), whole_version(spark, out, names=["a.csv", "b.csv"]) as staged:
        staged.write_csv(df, "a.csv")
        1 / 0
    assert os.listdir(out) == ["other"]
    for _ in range(2):
        with whole_version(spark, out, "overwrite", names=["a.csv", "b.csv"]) as staged:
            staged.write_csv(df, "a.csv")
            staged.write_csv(df.limit(1), "b.csv")
        assert sorted(os.listdir(out)) == ["a.csv", "b.csv", "other"]
    with pytest.raises(FileExistsError), whole_version(spark, out, names=["b.csv", "c.csv"]):
        pass
