"""File listing as a DataFrame, and one spelling for paths."""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in Python workers go there by value, so executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def canonical_path(metadata_path: Column | str = "_metadata.file_path") -> Column:
    """The path that a metadata column gives as an escaped URI (``%20`` for a
    blank, ``file:///``) in the spelling of ``list_files``: unescaped, local
    files as ``file:/...``. Listing, audit and exclusion all compare this."""
    path = F.col(metadata_path) if isinstance(metadata_path, str) else metadata_path
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # a plus sign is only itself in a path
    return F.regexp_replace(plain, "^file:/+", "file:/")


def store_and_path(uri: str):
    """Arrow's file system for a path in canonical spelling, and the path in
    it. Stores are those that Arrow reads: local and mounted files, HDFS and
    viewfs, S3, Google and Azure storage."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, path = rest.lstrip("/").partition("/")
    if scheme in ("hdfs", "viewfs"):
        host, _, port = authority.partition(":")
        return fs.HadoopFileSystem(f"{scheme}://{host}", int(port or 0)), "/" + path
    arrow_scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    store, _ = fs.FileSystem.from_uri(f"{arrow_scheme}://{authority}/")
    return store, f"{authority}/{path}"


def _hidden(relative: str) -> bool:
    """Names that Spark's readers leave out: ``.x``, and ``_x`` but for ``_k=v``."""
    return any(part.startswith(".") or (part.startswith("_") and "=" not in part) for part in relative.split("/"))


def _files_below(folder: str, glob: str) -> Iterator[tuple[str, int]]:
    """(path, length) of the files below a folder, or of the file itself."""
    from pyarrow import fs

    store, root = store_and_path(folder)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such folder: {folder}")
    if info.is_file:
        yield folder, info.size
        return
    for found in store.get_file_info(fs.FileSelector(root, recursive=True)):
        relative = found.path[len(root):].lstrip("/")
        if found.is_file and not _hidden(relative) and fnmatch.fnmatchcase(found.base_name, glob):
            yield f"{folder.rstrip('/')}/{relative}", found.size


def list_files(spark: SparkSession, paths: str | Sequence[str],
               glob: str = "*.parquet") -> DataFrame:
    """One row per file under ``paths`` matching ``glob``: path (canonical
    spelling), length. Files of no byte, which every scan skips, are listed.

    The folders are rows, listed by tasks, one folder at a time and all below
    it; the names never pass through the driver. A path without a scheme is in
    ``spark.hadoop.fs.defaultFS``, by default the local file system.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:").rstrip("/")
    full = [p if ":" in p.split("/")[0] else default + p for p in paths]
    folders = spark.createDataFrame([("file:/" + p[5:].lstrip("/") if p.startswith("file:") else p,)
                                     for p in full], "folder string").repartition(max(1, len(full)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = list(_files_below(folder, glob))
                for start in range(0, len(found), 10_000):
                    some = found[start:start + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in some], pa.string()),
                                                      "length": pa.array([n for _, n in some], pa.int64())})

    return folders.mapInArrow(work, "path string, length long")
