"""Audit of Parquet files: which can be decoded whole, and what is wrong with
the others."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.files import list_files, store_and_path

# As in ``sources.files``: functions for Python workers go there by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What is wrong with a file: no byte; no (sound) Parquet footer; a footer, but
#: values that can't be decoded.
NO_BYTES, BAD_FOOTER, BAD_DATA = "NO_BYTES", "BAD_FOOTER", "BAD_DATA"
#: Rows decoded at once.
BATCH_ROWS = 1 << 16

_UNIT = "path string, row_group int, rows long, expected_rows long, error_kind string, error string"


def _arrow_file(path: str):
    """A file opened by its footer, read from the end of the file."""
    import pyarrow.parquet as pq

    store, where = store_and_path(path)
    return pq.ParquetFile(store.open_input_file(where), page_checksum_verification=True)


def _attempt(work):
    """(result, None), or (None, message) if the bytes can't be decoded. A
    store that can't be read is no finding about the file and fails the audit."""
    try:
        return work(), None
    except (PermissionError, FileNotFoundError, ConnectionError):
        raise
    except (pa.ArrowException, OSError, ValueError) as found:
        return None, f"{type(found).__name__}: {found}"[:500]


def _units(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in _UNIT.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows
                                      else [pa.array([], k) for k in kinds], names=names)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row group that a file's footer promises; one row for a file
    without row groups or without a sound footer."""
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            if not length:
                yield _units([(path, None, None, None, NO_BYTES, "the file has no byte")])
                continue

            def promised() -> list[int]:
                meta = _arrow_file(path).metadata
                return [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]

            groups, error = _attempt(promised)
            if error:
                yield _units([(path, None, None, None, BAD_FOOTER, error)])
            else:
                yield _units([(path, i, None, n, None, None) for i, n in enumerate(groups)]
                             or [(path, None, 0, 0, None, None)])


def _decoded(columns: Sequence[str] | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                if unit["row_group"] is None:
                    yield _units([tuple(unit.values())])
                    continue

                def rows() -> int:
                    file = _arrow_file(unit["path"])
                    names = None if columns is None else [c for c in columns if c in file.schema_arrow.names]
                    return sum(b.num_rows for b in file.iter_batches(
                        BATCH_ROWS, row_groups=[unit["row_group"]], columns=names, use_threads=False))

                n, error = _attempt(rows)
                if error is None and n != unit["expected_rows"]:
                    error = f"{n} rows where the footer promises {unit['expected_rows']}"
                yield _units([(unit["path"], unit["row_group"], n, unit["expected_rows"],
                               None if error is None else BAD_DATA,
                               None if error is None else f"row group {unit['row_group']}: {error}")])

    return work


def _tasks(spark: SparkSession, files: DataFrame) -> int:
    """Tasks that Spark's own scan of these files would have, about."""
    def size(key: str, default: int) -> int:
        text = str(spark.conf.get(key, str(default))).strip().lower().removesuffix("b")
        unit = {"k": 10, "m": 20, "g": 30}.get(text[-1:], 0)
        return int(text[:-1] if unit else text) << unit

    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    split = size("spark.sql.files.maxPartitionBytes", 128 << 20)
    wanted = math.ceil((total.bytes + total.n * size("spark.sql.files.openCostInBytes", 4 << 20)) / split)
    wanted = max(wanted, spark.sparkContext.defaultParallelism)
    return max(1, min(wanted, max(total.n, math.ceil(total.bytes / (1 << 20)))))


def audit_parquet(spark: SparkSession, paths: str | Sequence[str],
                  columns: Sequence[str] | None = None) -> DataFrame:
    """One row per ``*.parquet`` file under ``paths``: path, readable, rows
    (null when unreadable), expected_rows (what the footer promises; null
    without a footer), error_kind (``NO_BYTES``, ``BAD_FOOTER``, ``BAD_DATA``)
    and error (what the reader said; both null when readable).

    Every value of every column is decoded by the file's own footer, so files
    with different columns can stand side by side; ``columns`` narrows this to
    those of these names that a file has. Tasks read the footer from the end of
    each file, whatever its length, deal the row groups out, and decode them one
    by one in batches; an error is caught where it arises and reported with the
    first row group that has one. A file without rows is readable. Missing
    permissions, a file that is gone and a store that does not answer fail the
    audit.
    """
    files = list_files(spark, paths)
    tasks = _tasks(spark, files)
    units = files.repartition(tasks, "path").mapInArrow(_footers, _UNIT)
    done = units.repartition(tasks, "path", "row_group").mapInArrow(_decoded(columns), _UNIT)
    first = F.min(F.when(F.col("error_kind").isNotNull(), F.struct("row_group", "error_kind", "error")))
    return (done.groupBy("path").agg(F.sum("rows").alias("decoded"), F.sum("expected_rows").alias("expected_rows"),
                                     first.alias("first"))
            .select("path", F.col("first").isNull().alias("readable"),
                    F.when(F.col("first").isNull(), F.col("decoded")).alias("rows"), "expected_rows",
                    F.col("first.error_kind").alias("error_kind"), F.col("first.error").alias("error")))


def failed_files(audit: DataFrame) -> DataFrame:
    """FAILED_FILES: the paths that could not be decoded."""
    return audit.filter(~F.col("readable")).select(F.col("path").alias("FAILED_FILES"))


def oversized_ids(cdr: DataFrame, max_length: int = 10) -> DataFrame:
    """Records whose SUBSCRIBER_ID is longer than ``max_length`` characters."""
    return cdr.filter(F.length(S.SUBSCRIBER_ID) > max_length)
