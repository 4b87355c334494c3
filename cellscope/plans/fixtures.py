"""Queries that go through files: Spark writes data derived from the
driver's tables into a fresh folder under the session's checkpoint folder,
then the library's sources read it back."""

from __future__ import annotations

import datetime as dt
import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.calendar import enrich
from ..operators import (appearance_counts, audit_parquet, class_counts, daily_presence,
                         residents_per_cell, spatial_appearance, top_location)
from ..operators import spatial_stages as spatial_tables
from ..operators.spatial import SLOT_COUNTS
from ..session import scratch_dir, store_of
from ..sinks import (read_csv, versioned_path, whole_version, whole_versions, write_csv,
                     write_intermediates)
from ..sources import demo, list_files, read_adjacency, read_cdr, read_cells

ONE_SECOND = dt.timedelta(seconds=1)
# Names and bytes of the files that the file queries add.
BAD_FILE, EMPTY_FILE = "part-99999-corrupt.snappy.parquet", "part-99998-empty.snappy.parquet"
NO_PARQUET = b"PAR1 this is no Parquet file PAR1"
ROWLESS_FILE, EXTRA_FILE = "part-99997-rowless.snappy.parquet", "part-99996-extra+column %.snappy.parquet"
FOOTER_BYTES = 1 << 20


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.cdr_from_events(demo.load(spark, sf_dir, "events"))


def write_cdr_dirs(spark: SparkSession, sf_dir: str, root: str) -> list[str]:
    """Raw CDR split into two half-month folders."""
    raw = _raw(spark, sf_dir)
    first = F.col(S.CALL_TIME) < F.lit("20240116000000")
    dirs = [f"{root}/records_a", f"{root}/records_b"]
    raw.filter(first).write.parquet(dirs[0])
    raw.filter(~first | F.col(S.CALL_TIME).isNull()).write.parquet(dirs[1])
    return dirs


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of these bytes, through Spark's own file access."""
    store, where = store_of(spark, path)
    out = store.create(where)
    out.write(bytearray(data))
    out.close()


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``top_location`` written as header CSV (distributed parts) and read
    back with the count cast to bigint."""
    root = scratch_dir(spark, "csv")
    loc = top_location(appearance_counts(daily_presence(enrich(_raw(spark, sf_dir)))))
    write_csv(loc, f"{root}/top_location")
    return read_csv(spark, f"{root}/top_location", {S.MAX_APPEARANCE_COUNT: "bigint"})


def adjacency_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated adjacency as a headerless CSV, read with the fixed schema."""
    root = scratch_dir(spark, "adjacency")
    adj = demo.adjacency_from_nations(demo.load(spark, sf_dir, "nation"))
    adj.write.csv(f"{root}/adjacency")
    return read_adjacency(spark, f"{root}/adjacency")


def cells_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell attributes as a header CSV, read back with every column as text."""
    root = scratch_dir(spark, "cells")
    demo.cells_from_nations(demo.load(spark, sf_dir, "nation"), demo.load(spark, sf_dir, "region")) \
        .write.option("header", "true").csv(f"{root}/cells")
    return read_cells(spark, f"{root}/cells")


def csv_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residents per cell written as one part file and read back, with the
    number of part files."""
    root = scratch_dir(spark, "single")
    loc = top_location(appearance_counts(daily_presence(enrich(_raw(spark, sf_dir)))))
    write_csv(residents_per_cell(loc), f"{root}/counts", single_file=True)
    files = list_files(spark, f"{root}/counts", "part-*").agg(F.count(F.lit(1)).alias("PART_FILES"))
    return read_csv(spark, f"{root}/counts", {S.COUNT_IN_1KM_CELL: "bigint"}).crossJoin(F.broadcast(files))


def csv_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations written under two versions of one layout, then a version whose
    second result can't be written; read back are all results of the versions
    that are there: a version never holds another's rows, and of the failed one
    nothing is seen."""
    root = scratch_dir(spark, "versions")
    loc = top_location(appearance_counts(daily_presence(enrich(_raw(spark, sf_dir))))).persist()
    try:
        for version, cls in enumerate((S.HOME_HOUR, S.WORK_HOUR), start=1):
            with whole_version(spark, versioned_path(root, "tc", version)) as staged:
                staged.write_csv(class_counts(loc, cls), "locations.csv")
        try:
            with whole_version(spark, versioned_path(root, "tc", 3)) as staged:
                staged.write_csv(loc, "locations.csv")
                staged.write_csv(loc, "locations.csv")  # is there already
        except AnalysisException:
            pass
        both = None
        for version, names in whole_versions(spark, root, "tc").items():
            for name in names:
                back = read_csv(spark, versioned_path(root, "tc", version, name), {S.MAX_APPEARANCE_COUNT: "bigint"})
                back = back.withColumn("VERSION", F.lit(int(version)))
                both = back if both is None else both.unionByName(back)
        return both
    finally:
        loc.unpersist()


def spatial_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage tables of the spatial job, dumped as CSV and read back, one
    below the other under their names; a table's missing columns are null."""
    root = scratch_dir(spark, "stages")
    counts = appearance_counts(daily_presence(enrich(_raw(spark, sf_dir))))
    adjacency = demo.adjacency_from_nations(demo.load(spark, sf_dir, "nation"))
    tables = spatial_tables(counts, spatial_appearance(counts, adjacency), adjacency)
    write_intermediates(tables, root)
    together = None
    for name in tables:
        back = read_csv(spark, f"{root}/{name}", {c: "bigint" for c in (S.APPEARANCE_COUNT, *SLOT_COUNTS)
                                                  if c in tables[name].columns})
        back = back.withColumn("STAGE", F.lit(name))
        together = back if together is None else together.unionByName(back, allowMissingColumns=True)
    return together


def rowless_file(footer_bytes: int) -> bytes:
    """A sound Parquet file without rows whose footer has this many bytes."""
    empty = pa.table({f.name: pa.array([], pa.string()) for f in S.CDR}).replace_schema_metadata(
        {"padding": "x" * footer_bytes})
    out = io.BytesIO()
    pq.write_table(empty, out)
    return out.getvalue()


def damaged_column_file(name: str) -> bytes:
    """A Parquet file with the CDR columns, which are sound, and one more, of
    which every byte is overwritten."""
    rows = pa.table({f.name: pa.array(["1", "2"]) for f in S.CDR} | {name: pa.array(["x", "y"])})
    out = io.BytesIO()
    pq.write_table(rows, out, use_dictionary=False)
    data = bytearray(out.getvalue())
    chunk = pq.ParquetFile(io.BytesIO(data)).metadata.row_group(0).column(len(S.CDR))
    start, size = chunk.data_page_offset, chunk.total_compressed_size
    data[start:start + size] = b"\xff" * size
    return bytes(data)


def cdr_excluding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDR read from two folders while two corrupt files are excluded by path
    suffix, one with a name that URIs escape; equal to the whole enriched CDR."""
    root = scratch_dir(spark, "exclude")
    dirs = write_cdr_dirs(spark, sf_dir, root)
    write_bytes(spark, f"{dirs[0]}/{BAD_FILE}", NO_PARQUET)
    write_bytes(spark, f"{dirs[1]}/{EXTRA_FILE}", NO_PARQUET)
    return read_cdr(spark, dirs, exclude=[f"records_a/{BAD_FILE}", f"records_b/{EXTRA_FILE}"])


def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two folders of good files, and among them one that is no
    Parquet file, one without any byte, one damaged only in a column of its own
    and one without rows but with a long footer: those that can't be decoded by
    name and kind of error, the others' rows summed by folder."""
    root = scratch_dir(spark, "audit")
    dirs = write_cdr_dirs(spark, sf_dir, root)
    write_bytes(spark, f"{dirs[1]}/{BAD_FILE}", NO_PARQUET)
    write_bytes(spark, f"{dirs[1]}/{EMPTY_FILE}", b"")
    write_bytes(spark, f"{dirs[0]}/{ROWLESS_FILE}", rowless_file(FOOTER_BYTES))
    write_bytes(spark, f"{dirs[0]}/{EXTRA_FILE}", damaged_column_file("EXTRA"))
    folder, name = (F.element_at(F.split("path", "/"), -i) for i in (2, 1))
    shown = F.when(F.col("readable") & (name != ROWLESS_FILE), folder).otherwise(name)
    return (audit_parquet(spark, dirs)
            .groupBy(shown.alias("NAME"), F.col("readable").alias("READABLE"), F.col("error_kind").alias("ERROR_KIND"))
            .agg(F.sum("rows").alias("ROWS")))
