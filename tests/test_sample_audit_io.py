import datetime as dt
import hashlib
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellscope import schemas as S
from cellscope.operators import (audit_parquet, failed_files, oversized_ids, regional_records,
                                 sample_users, user_sample)
from cellscope.plans import fixtures, jobs
from cellscope.session import scratch_dir
from cellscope.sinks import read_csv, versioned_path, write_csv, write_intermediates
from cellscope.sources import list_files, read_adjacency, read_cdr
from cellscope.sources.files import canonical_path
from conftest import rows

AREAS = [("79.8", "6.9", "0001", "Western", "Colombo", "DS1", "c1", "1.0"),
         ("80.6", "7.3", "0002", "Central", "Kandy", "DS2", "c2", "2.0")]


def test_regional_records_inclusive_end(spark, cdr):
    df = cdr([("u", "20131110000000", "c1"), ("u", "20131110000001", "c1"),
              ("u", "20131105000000", "c2"), ("v", "20131031235959", "c1")])
    areas = spark.createDataFrame(AREAS, S.AREAS)
    out = regional_records(df, areas, "Western", dt.date(2013, 11, 1), dt.date(2013, 11, 10))
    assert out.columns == list(S.SAMPLE_COLUMNS)
    assert [r.CALL_TIMESTAMP for r in out.collect()] == [dt.datetime(2013, 11, 10)]


def _brute(ids, n, seed):
    return sorted(sorted(set(ids), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[:n])


@pytest.mark.parametrize("n", [1, 37, 2500, 6000, 7000])
def test_sample_users_equals_brute_force(spark, n):
    ids = [f"user{i}" for i in range(6000)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:100] + [None]], "SUBSCRIBER_ID string")
    got = sorted(r.SUBSCRIBER_ID for r in sample_users(df, n, seed=7).collect())
    assert got == _brute(ids, n, 7)


def test_sample_same_seed_same_sample(spark):
    df = spark.createDataFrame([(f"u{i}", f"c{i % 3}") for i in range(500)], "SUBSCRIBER_ID string, c string")
    a = rows(user_sample(df, 20, 3))
    assert a == rows(user_sample(df.repartition(7), 20, 3))
    assert a != rows(user_sample(df, 20, 4))
    assert len({r[0] for r in a}) == 20


def test_oversized_ids(spark):
    df = spark.createDataFrame([("12345678901", "t", "c"), ("123", "t", "c")], S.CDR)
    assert [r.SUBSCRIBER_ID for r in oversized_ids(df).collect()] == ["12345678901"]


@pytest.fixture
def cdr_files(spark):
    root = scratch_dir(spark, "test").removeprefix("file:")
    os.makedirs(root)
    rows_ = [(f"u{i % 13}", f"201301{1 + i % 28:02d}{i % 24:02d}0000", f"c{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows_, S.CDR)
    df.repartition(3).write.option("parquet.block.size", 4096).parquet(f"{root}/a")
    df.repartition(2).write.parquet(f"{root}/b")
    return root, len(rows_) * 2


def _parts(d):
    return sorted(f for f in os.listdir(d) if f.startswith("part-") and f.endswith(".parquet"))


def corrupt_copy(good, target, keep_fraction=None, late=False):
    """Copy and damage a local file: cut it, or (``late``) overwrite the column
    chunks of its last row group, which footer and earlier row groups survive."""
    shutil.copyfile(good, target)
    if keep_fraction is not None:
        with open(target, "r+b") as f:
            f.truncate(int(os.path.getsize(target) * keep_fraction))
    if late:
        meta = pq.ParquetFile(good).metadata
        group = meta.row_group(meta.num_row_groups - 1)
        chunks = [group.column(i) for i in range(group.num_columns)]
        start = min(c.dictionary_page_offset or c.data_page_offset for c in chunks)
        end = max((c.dictionary_page_offset or c.data_page_offset) + c.total_compressed_size for c in chunks)
        with open(target, "r+b") as f:
            f.seek(start)
            f.write(b"\xff" * (end - start))


def test_audit_finds_bad_files(spark, cdr_files):
    root, _ = cdr_files
    good = f"{root}/a/{_parts(f'{root}/a')[0]}"
    corrupt_copy(good, f"{root}/a/late.parquet", late=True)
    corrupt_copy(good, f"{root}/a/truncated.parquet", keep_fraction=0.5)
    open(f"{root}/a/zero.parquet", "wb").close()
    shutil.copyfile(good, f"{root}/a/odd name +%.parquet")
    pq.write_table(pq.read_table(good).slice(0, 0), f"{root}/a/norows.parquet")
    audit = audit_parquet(spark, [f"{root}/a", f"{root}/b"])
    res = {os.path.basename(r.path): r for r in audit.collect()}
    bad = {"late.parquet", "truncated.parquet", "zero.parquet"}
    assert len(res) == 5 + 5
    assert {k for k, r in res.items() if not r.readable} == bad
    assert res["norows.parquet"].rows == 0
    assert sum(r.rows for k, r in res.items() if r.readable and k.startswith("part-")) == 6000
    assert {os.path.basename(r.FAILED_FILES) for r in failed_files(audit).collect()} == bad


def test_audit_says_what_is_wrong(spark, cdr_files):
    root, _ = cdr_files
    good = f"{root}/a/{_parts(f'{root}/a')[0]}"
    corrupt_copy(good, f"{root}/a/late.parquet", late=True)
    corrupt_copy(good, f"{root}/a/truncated.parquet", keep_fraction=0.5)
    open(f"{root}/a/zero.parquet", "wb").close()
    with open(f"{root}/a/extra %41+ column.parquet", "wb") as f:
        f.write(fixtures.damaged_column_file("EXTRA"))
    with open(f"{root}/a/rowless.parquet", "wb") as f:
        f.write(fixtures.rowless_file(17 << 20))
    other = pq.read_table(good).append_column("N", pa.array([1.5] * pq.read_metadata(good).num_rows))
    pq.write_table(other, f"{root}/a/wider.parquet")
    res = {os.path.basename(r.path): r for r in audit_parquet(spark, f"{root}/a").collect()}
    assert {k: r.error_kind for k, r in res.items() if not r.readable} == {
        "late.parquet": "BAD_DATA", "truncated.parquet": "BAD_FOOTER", "zero.parquet": "NO_BYTES",
        "extra %41+ column.parquet": "BAD_DATA"}
    last = pq.read_metadata(good).num_row_groups - 1
    assert res["late.parquet"].error.startswith(f"row group {last}: ") and res["late.parquet"].rows is None
    assert res["late.parquet"].expected_rows == pq.read_metadata(good).num_rows
    assert (res["rowless.parquet"].rows, res["rowless.parquet"].error) == (0, None)
    assert res["wider.parquet"].rows == other.num_rows
    narrow = {os.path.basename(r.path): r.readable for r in audit_parquet(
        spark, f"{root}/a", columns=[f.name for f in S.CDR]).collect()}
    assert narrow["extra %41+ column.parquet"] and not narrow["late.parquet"]


def test_audit_of_nothing_and_of_missing_folders(spark, tmp_path):
    assert audit_parquet(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="no such folder"):
        audit_parquet(spark, str(tmp_path / "none")).collect()


def test_listing_names_files_as_they_are_called(spark, tmp_path):
    (tmp_path / "k=1" / "_hidden").mkdir(parents=True)
    names = ["a b+%20.parquet", "k=1/é.parquet", "k=1/_hidden/x.parquet", ".y.parquet", "_z.parquet", "n.csv"]
    for name in names:
        (tmp_path / name).write_bytes(b"12")
    (tmp_path / "zero.parquet").write_bytes(b"")
    found = {r.path: r.length for r in list_files(spark, f"file://{tmp_path}").collect()}
    assert found == {f"file:{tmp_path}/a b+%20.parquet": 2, f"file:{tmp_path}/k=1/é.parquet": 2,
                     f"file:{tmp_path}/zero.parquet": 0}
    assert found == {r.path: r.length for r in list_files(spark, str(tmp_path)).collect()}


def test_a_files_path_is_spelled_alike_by_listing_and_scan(spark, tmp_path):
    df = spark.createDataFrame([("u", "20130101000000", "c")], S.CDR)
    for name in ("a b", "c+%41", "é#?", "plain"):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    folders = [str(tmp_path / n) for n in ("a b", "c+%41", "é#?", "plain")]
    scanned = spark.read.parquet(*folders).select(canonical_path().alias("path"))
    assert {r.path for r in scanned.collect()} == {r.path for r in list_files(spark, folders).collect()}


def test_audit_job_decodes_in_as_many_tasks_as_the_scan_has(spark, tmp_path):
    # 24 files, one split each: the job's write must not narrow the decode.
    data = tmp_path / "generated"
    spark.createDataFrame([(f"u{i}", "20130101000000", "c") for i in range(2400)], S.CDR) \
        .repartition(24).write.option("parquet.block.size", 1024).parquet(str(data))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    tracker, group = spark.sparkContext.statusTracker(), "audit-tasks"
    try:
        spark.sparkContext.setJobGroup(group, "audit")
        jobs.unreadable_files_job(spark, str(tmp_path), paths=[str(data)], single_file=True)
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group)
                 for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(t >= 24 for t in tasks) >= 2


@pytest.mark.parametrize("name", ["bad file +%.parquet", "bad%20file.parquet", "bäd#file.parquet"])
def test_excluded_file_with_an_odd_name_is_never_opened(spark, cdr_files, name):
    root, n = cdr_files
    corrupt_copy(f"{root}/b/{_parts(f'{root}/b')[0]}", f"{root}/b/{name}", keep_fraction=0.3)
    assert read_cdr(spark, [f"{root}/a", f"{root}/b"], exclude=[f"b/{name}"]).count() == n
    with pytest.raises(Exception):
        read_cdr(spark, [f"{root}/a", f"{root}/b"], exclude=[f"a/{name}"]).count()


def test_excluded_corrupt_file_is_never_opened(spark, cdr_files):
    root, n = cdr_files
    corrupt_copy(f"{root}/b/{_parts(f'{root}/b')[0]}", f"{root}/b/part-bad.parquet", keep_fraction=0.3)
    df = read_cdr(spark, [f"{root}/a", f"{root}/b"], exclude=["b/part-bad.parquet"])
    assert df.count() == n
    with pytest.raises(Exception):
        read_cdr(spark, [f"{root}/a", f"{root}/b"]).count()


def test_read_cdr_week_range_and_period(spark, cdr_files):
    root, n = cdr_files
    all_ = read_cdr(spark, [f"{root}/a", f"{root}/b"])
    wk = read_cdr(spark, [f"{root}/a", f"{root}/b"], weeks=(2, 3))
    assert wk.count() == all_.filter(F.col("WEEK_OF_YEAR").between(2, 3)).count() > 0
    day = read_cdr(spark, [f"{root}/a"], period=(dt.datetime(2013, 1, 5), dt.datetime(2013, 1, 6)))
    assert day.count() == read_cdr(spark, [f"{root}/a"]).filter(F.col("DATE_OF_YEAR") == 5).count()


def test_adjacency_csv_with_schema(spark):
    root = scratch_dir(spark, "test").removeprefix("file:")
    os.makedirs(root)
    with open(f"{root}/adj.txt", "w") as f:
        f.write("A,B,,,\nB,A,C,,\n")
    adj = read_adjacency(spark, f"{root}/adj.txt")
    assert adj.columns == ["ADJ_INDEX_1KM", "ADJ_1", "ADJ_2", "ADJ_3", "ADJ_4"]
    assert rows(adj) == [("A", "B", None, None, None), ("B", "A", "C", None, None)]


def test_csv_round_trip_and_no_overwrite(spark):
    root = scratch_dir(spark, "test").removeprefix("file:")
    os.makedirs(root)
    df = spark.createDataFrame([("u", "a", 3), ("v", None, 1)], "SUBSCRIBER_ID string, INDEX_1KM string, N bigint")
    path = versioned_path(root, "tc", 1, "homeYear", "subscriberLocationByCellId.csv")
    assert path.endswith("/output/tc/1/homeYear/subscriberLocationByCellId.csv")
    write_csv(df, path, single_file=True)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 1
    back = read_csv(spark, path, {"N": "bigint"})
    assert rows(back) == rows(df)
    with pytest.raises(Exception):
        write_csv(df, path)
    write_intermediates({"t1": df}, f"{root}/debug")
    assert os.path.isdir(f"{root}/debug/t1")
    write_intermediates({"t1": df}, None)
