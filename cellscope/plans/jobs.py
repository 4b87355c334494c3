"""The six batch jobs as functions: read, compute, write.

Each job builds one plan; when a job writes several results from the same
intermediate (locations for home, work, residents and the merge), that
intermediate is persisted for the job's duration and released at the end,
so the CDR is scanned once per job instead of once per output.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..functions.calendar import day_bounds
from ..operators import (appearance_counts, audit_parquet, cells_as_text, class_counts,
                         daily_presence, failed_files, home_work, hourly_cell_counts, hourly_top_cell,
                         hourly_trajectory, regional_records, residents_map, residents_per_cell,
                         spatial_appearance, spatial_stages, top_location, user_sample)
from ..session import ensure_checkpoint_dir
from ..sinks import read_csv, versioned_path, whole_version
from ..sources import read_adjacency, read_cdr, read_cells

# Layout of the original data root and result names.
CDR_DIRS = ("generated_voice_records_20121201_20130601",
            "generated_voice_records_20130601_20131201")
ADJACENCY_FILE = "4_adjacent_cells.txt"
LOCATIONS_CSV = "subscriberLocationByCellId.csv"
CELL_COUNTS_CSV = "locationSubscriberCount.csv"
HOME_WORK_CSV = "homeWorkJoined.csv"
CLASS_DIRS = {S.HOME_HOUR: "homeYear", S.WORK_HOUR: "workYear"}


def cdr_dirs(data_root: str) -> list[str]:
    return [f"{data_root.rstrip('/')}/{d}" for d in CDR_DIRS]


COUNTS = {c: "bigint" for c in ("HOME_APPEARANCE_COUNT", "WORK_APPEARANCE_COUNT",
                                S.MAX_APPEARANCE_COUNT, S.MAX_APEARENCE_COUNT, S.COUNT_IN_1KM_CELL)}
SPATIAL_COUNTS = COUNTS | {c: "double" for c in ("HOME_APPEARANCE_COUNT", "WORK_APPEARANCE_COUNT",
                                                 S.MAX_APPEARANCE_COUNT)}


def _locations_out(loc: DataFrame) -> DataFrame:
    return loc.select(S.SUBSCRIBER_ID, S.INDEX_1KM, S.MAX_APPEARANCE_COUNT)


def _read_back(spark: SparkSession, path: str, df: DataFrame, casts: dict[str, str] = COUNTS) -> DataFrame:
    """What was written of ``df``, so that using a job's result later reads the
    result and computes nothing again."""
    return read_csv(spark, path, {c: t for c, t in casts.items() if c in df.columns})


def _written(df: DataFrame, path: str, single_file: bool, mode: str,
             casts: dict[str, str] = COUNTS) -> DataFrame:
    """One result as a version of its own, read back."""
    with whole_version(df.sparkSession, path, mode) as staged:
        staged.write_csv(df, single_file=single_file)
    return _read_back(df.sparkSession, path, df, casts)


def home_work_job(spark: SparkSession, data_root: str, version: str | int = 1,
                  weeks: tuple[int, int] | None = (0, 53), one_per_subscriber: bool = True,
                  spatial: bool = False, weight: float = 0.5,
                  paths: Sequence[str] | None = None, exclude: Sequence[str] = (),
                  adjacency: DataFrame | None = None, out_root: str | None = None,
                  debug: bool = False, single_file: bool = False,
                  mode: str = "errorifexists") -> dict[str, DataFrame]:
    """Annual home / work cells (J1), or with spatial certainty (J2,
    ``spatial=True``, adjacency from ``{data_root}/4_adjacent_cells.txt``).

    Writes under ``{out_root}/output/{tc|sc}/{version}/``: per class the
    locations and the subscribers per cell, then the merged home-work table
    (``single_file`` for one part file). The version appears whole or not at
    all. Returns the written tables. Files to leave out are named by ``exclude``
    (path suffixes).
    """
    out_root = out_root or data_root
    out = versioned_path(out_root, "sc" if spatial else "tc", version)
    casts = SPATIAL_COUNTS if spatial else COUNTS
    cdr = read_cdr(spark, paths or cdr_dirs(data_root), exclude=exclude, weeks=weeks)
    held = [appearance_counts(daily_presence(cdr))]
    written: dict[str, tuple[DataFrame, tuple[str, ...]]] = {}
    try:
        with whole_version(spark, out, mode) as staged:
            if spatial:
                if adjacency is None:
                    adjacency = read_adjacency(spark, f"{data_root.rstrip('/')}/{ADJACENCY_FILE}")
                if debug:
                    held[0] = held[0].persist(StorageLevel.MEMORY_AND_DISK)
                held.append(spatial_appearance(held[0], adjacency, weight))
                if debug:
                    held[1] = held[1].persist(StorageLevel.MEMORY_AND_DISK)
                    for name, table in spatial_stages(held[0], held[1], adjacency).items():
                        staged.write_csv(table, "debug", name)
            held.append(top_location(held[-1], one_per_subscriber).persist(StorageLevel.MEMORY_AND_DISK))
            loc = held[-1]
            for hw, sub in CLASS_DIRS.items():
                per_class = class_counts(loc, hw)
                written[hw] = _locations_out(per_class), (sub, LOCATIONS_CSV)
                written[f"{hw}_PER_CELL"] = residents_per_cell(per_class), (sub, CELL_COUNTS_CSV)
            # With ties kept the cell columns are arrays; CSV gets them as text.
            written["home_work"] = cells_as_text(home_work(loc, one_per_subscriber)), (HOME_WORK_CSV,)
            for name, (df, parts) in written.items():
                staged.write_csv(df, *parts, single_file=single_file and name == "home_work")
        return {name: _read_back(spark, "/".join((out, *parts)), df, casts)
                for name, (df, parts) in written.items()}
    finally:
        for df in held:
            df.unpersist()


def residents_map_job(spark: SparkSession, data_root: str,
                      paths: Sequence[str] | None = None, exclude: Sequence[str] = (),
                      centres: DataFrame | None = None, out_root: str | None = None,
                      single_file: bool = False, mode: str = "errorifexists") -> dict[str, DataFrame]:
    """Home / work cells with ties kept over the whole input, subscribers per
    cell, and the residents map joined to the cell centres (J3). Returns the
    written maps by class."""
    # The inputs and result names of this job.
    root = data_root.rstrip("/")
    out = f"{(out_root or data_root).rstrip('/')}/output"
    cdr = read_cdr(spark, paths or [f"{root}/synv_20130601_20131201"], exclude=exclude, with_year=False)
    if centres is None:
        centres = read_cells(spark, f"{root}/1KM_CELL_CENTRES.csv")
    ties = top_location(appearance_counts(daily_presence(cdr)), one_per_subscriber=False)
    ties = ties.persist(StorageLevel.MEMORY_AND_DISK)
    names = {S.HOME_HOUR: ("HomeYearOutput.csv", "SumHome.csv", "homeRecidentCount.csv"),
             S.WORK_HOUR: ("WorkYearOutput.csv", "SumWork.csv", "workRecidentCount.csv")}
    written: dict[str, DataFrame] = {}
    for hw, (loc_csv, sum_csv, map_csv) in names.items():
        per_class = class_counts(ties, hw)
        residents = residents_per_cell(per_class)
        written[loc_csv] = _locations_out(per_class).withColumnRenamed(S.MAX_APPEARANCE_COUNT, S.MAX_APEARENCE_COUNT)
        written[sum_csv] = residents.withColumnRenamed(S.LOCATION_ID, S.INDEX_1KM)
        written[map_csv] = residents_map(residents, centres)
    try:
        with whole_version(spark, out, mode, names=list(written)) as staged:
            for name, df in written.items():
                staged.write_csv(df, name, single_file=single_file)
        return {hw: _read_back(spark, f"{out}/{map_csv}", written[map_csv])
                for hw, (_, _, map_csv) in names.items()}
    finally:
        ties.unpersist()


def hourly_trajectory_job(spark: SparkSession, data_root: str, version: str | int = 1,
                          year: int = 2013, day_of_year: int = 1,
                          paths: Sequence[str] | None = None, exclude: Sequence[str] = (),
                          out_root: str | None = None, single_file: bool = False,
                          mode: str = "errorifexists") -> DataFrame:
    """Modal cell of every hour of one day per subscriber (J4). Only the
    day's rows are read (text-range pushdown on CALL_TIME). Written to
    ``output/SimMobility/{version}/{year}_{day}``: with the year in the path
    two years' same day numbers do not collide."""
    cdr = read_cdr(spark, paths or cdr_dirs(data_root), exclude=exclude,
                   period=day_bounds(year, day_of_year))
    traj = hourly_trajectory(hourly_top_cell(hourly_cell_counts(cdr, year, day_of_year)))
    return _written(traj, versioned_path(out_root or data_root, "SimMobility", version,
                                         f"{year}_{day_of_year}"), single_file, mode)


def regional_sample_job(spark: SparkSession, data_root: str, province: str = "Western",
                        start: dt.date | dt.datetime = dt.date(2013, 11, 1),
                        end: dt.date | dt.datetime = dt.date(2013, 11, 10),
                        n_users: int = 20_000, seed: int | str = 42,
                        paths: Sequence[str] | None = None, exclude: Sequence[str] = (),
                        areas: DataFrame | None = None, materialize: bool = True,
                        out_path: str | None = None, single_file: bool = False,
                        mode: str = "errorifexists") -> DataFrame:
    """All records of ``n_users`` seeded-random users seen in ``province``
    between ``start`` and ``end`` (inclusive), with area attributes (J5).

    ``materialize`` writes the regional records once to the checkpoint
    folder, so sampling and the final selection do not scan the CDR twice.
    """
    root = data_root.rstrip("/")
    if areas is None:
        areas = read_cells(spark, f"{root}/1K_CELL_CENTERS_ALL.CSV")
    lo = dt.datetime.combine(start, dt.time()) if not isinstance(start, dt.datetime) else start
    hi = dt.datetime.combine(end, dt.time()) if not isinstance(end, dt.datetime) else end
    cdr = read_cdr(spark, paths or cdr_dirs(data_root), exclude=exclude, with_year=False,
                   period=(lo, hi + dt.timedelta(seconds=1)))
    records = regional_records(cdr, areas, province, lo, hi)
    if materialize:
        ensure_checkpoint_dir(spark)
        records = records.checkpoint(eager=True)
    return _written(user_sample(records, n_users, seed),
                    out_path or f"{root}/output/SampleUserFor{province}.csv", single_file, mode,
                    {S.CALL_TIMESTAMP: "timestamp_ntz"})


def unreadable_files_job(spark: SparkSession, data_root: str, version: str | int = 1,
                         paths: Sequence[str] | None = None, out_root: str | None = None,
                         single_file: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Audit every Parquet file of the data folders and write the ones that
    cannot be decoded as FAILED_FILES (J6). Returns the written table."""
    bad = failed_files(audit_parquet(spark, paths or cdr_dirs(data_root)))
    return _written(bad, f"{(out_root or data_root).rstrip('/')}/output/{version}/decodingFailedFiles.csv",
                    single_file, mode)
