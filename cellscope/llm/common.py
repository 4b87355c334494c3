"""Helpers shared by the text operators: shipping this package to executors,
scratch tables in the cluster's shared folder, Arrow batch mapping."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per application),
    with Spark's own ``addPyFile``; needed when it is not installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, root))
    target = os.path.join(tempfile.mkdtemp(prefix="cellscope-code-"), "cellscope_code.zip")
    with open(target, "wb") as out:
        out.write(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``. Unset is
    allowed only for a local master (tests), where a temporary folder serves;
    on a cluster executors would not see each other's files."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file:" + tempfile.mkdtemp(prefix="cellscope-llm-")
        _scratch[app] = f"{base.rstrip('/')}/cellscope-{app}"
    return _scratch[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts
    the lineage with files that outlive an executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and the shuffle files
    of jobs that are over."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for name in df.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    for df in tables[:1]:
        sweep(df.sparkSession)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over. It does so
    after a collection of the driver's garbage, by default every half hour, in
    which a chain of jobs would fill the disks."""
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application stored, once no result that was
    computed from them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, null text as ''. Other
    columns, whatever their names, never reach an operator's work."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def map_batches(df: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]],
                schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns."""
    ship(df.sparkSession)
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(shape)

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array)
                 else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, shape)


def slices(batches: Iterable[pa.RecordBatch], max_rows: int = 2000,
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``max_rows`` rows and about
    ``max_bytes`` of text (a longer text is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and (held + size > max_bytes or row - start >= max_rows):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def partition_number() -> int:
    return TaskContext.get().partitionId()


#: A row is known by two hashes of its id and text; identical rows share them.
KEY = "k1 long, k2 int"


def keys_of(rows: DataFrame, row_id) -> DataFrame:
    return rows.withColumn("k1", F.xxhash64(row_id, "text")).withColumn("k2", F.hash("text", row_id))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null as ''), and the keys of the row."""
    return keys_of(two_columns(df, id_col, text_col), F.col("doc_id"))


def rows_with_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole rows as struct ``row``, whatever their columns are called, with
    text and keys beside it."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    return keys_of(rows.withColumn("text", text), F.col(f"row.`{id_col}`"))


def rewritten(df: DataFrame, made: DataFrame, text_col: str, new_text: str = "new_text") -> DataFrame:
    """The columns of ``df`` from struct ``row`` of ``made``, with the new text
    in place of the old; a null text stays null."""
    return made.select(*(F.when(F.col(f"row.`{c}`").isNotNull(), F.col(new_text)).alias(c) if c == text_col
                         else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def with_row(df: DataFrame, more: str) -> T.StructType:
    """A schema of struct ``row`` (the columns of ``df``) and ``more``."""
    fields = T.StructType.fromDDL(more).fields
    return T.StructType([T.StructField("row", df.schema), *fields])
