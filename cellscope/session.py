"""Session helpers: scratch location and a local session for tests/bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (from ``spark.checkpoint.dir``). Only a
    local session may have none configured and gets a temporary one; executors
    of a cluster would each write to a folder of their own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cellscope-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """The URI of a new folder under the shared checkpoint folder, in whatever
    store that is; Spark's writers create it."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")
    return f"{base}/cellscope-{name}-{uuid.uuid4().hex[:12]}"


def store_of(spark: SparkSession, path: str):
    """(file system, path) objects of Spark's own file access."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose data nothing reads any more."""
    store, where = store_of(spark, path)
    store.delete(where, True)


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "cellscope", conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and benchmarks: AQE on, UI off, UTC; ``conf``
    adds settings (e.g. an event log in a scratch folder)."""
    parts = shuffle_partitions or (8 if cores == "*" else max(2, int(cores) * 2))
    builder = SparkSession.builder
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = (builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(parts))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
