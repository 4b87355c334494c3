"""Versions of results that appear whole or not at all.

The outputs of a version are written under a hidden folder beside its place,
with a manifest of their names. One rename then puts the folder in place. Until
then no reader sees any of it; after a failure nothing is left in the way of a
rerun. Renaming a folder is one step on HDFS and local or mounted file systems;
on an object store, where it is a copy, readers go by the manifest, which is
asked for by ``whole_versions``.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import remove, store_of
from .csv import versioned_path, write_csv

MANIFEST = "_MANIFEST.json"
STAGING = ".staging-"


class Staged:
    """The hidden folder that a version is written to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder, []

    def write_csv(self, df: DataFrame, *parts: str, single_file: bool = False) -> None:
        """``df`` as CSV under the version's folder (no ``parts``: as the
        folder itself)."""
        name = "/".join(parts)
        write_csv(df, f"{self.folder}/{name}".rstrip("/"), single_file=single_file)
        self.names.append(name)


def exists(spark: SparkSession, path: str) -> bool:
    store, where = store_of(spark, path)
    return store.exists(where)


def rename(spark: SparkSession, old: str, new: str) -> None:
    store, where = store_of(spark, new)
    store.mkdirs(where.getParent())
    if store.exists(where) or not store.rename(store_of(spark, old)[1], where):
        raise FileExistsError(f"can't put {old} in place as {new}")


def write_manifest(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    store, where = store_of(spark, f"{folder}/{MANIFEST}")
    out = store.create(where)
    out.write(bytearray(json.dumps({"results": sorted(names)}).encode()))
    out.close()


@contextlib.contextmanager
def whole_version(spark: SparkSession, path: str, mode: str = "errorifexists",
                  names: Sequence[str] | None = None) -> Iterator[Staged]:
    """Within this context a version is written to ``Staged``; at its end it
    stands at ``path``. An exception leaves ``path`` as it was: missing, or, in
    mode ``overwrite``, the version before. Mode ``errorifexists`` refuses a
    path that is there.

    ``names``: ``path`` is a folder that other results share, and the results
    of these names are put there one by one, after all are written.
    """
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError(f"a whole version is new or replaces one: mode {mode!r} does neither")
    places = [path] if names is None else [f"{path}/{name}" for name in names]
    if mode != "overwrite":
        there = [p for p in places if exists(spark, p)]
        if there:
            raise FileExistsError(f"{there[0]} is there already")
    parent, _, last = path.rstrip("/").rpartition("/")
    staged = Staged(spark, f"{parent}/{STAGING}{last}-{uuid.uuid4().hex[:12]}")
    before = f"{parent}/{STAGING}before-{last}-{uuid.uuid4().hex[:12]}"
    try:
        yield staged
        if names is None:
            write_manifest(spark, staged.folder, staged.names)
            if exists(spark, path) and mode == "overwrite":
                rename(spark, path, before)
            rename(spark, staged.folder, path)
        else:
            for name, place in zip(names, places):
                if exists(spark, place) and mode == "overwrite":
                    rename(spark, place, f"{before}/{name}")
                rename(spark, f"{staged.folder}/{name}", place)
    except BaseException:
        if names is None and exists(spark, before) and not exists(spark, path):
            rename(spark, before, path)
        raise
    finally:
        for left in (staged.folder, before):
            if exists(spark, left):
                remove(spark, left)


def whole_versions(spark: SparkSession, root: str, family: str) -> dict[str, list[str]]:
    """The versions of a family that are there whole, each with the names of
    its results (a family has few versions)."""
    store, where = store_of(spark, versioned_path(root, family, "").rstrip("/"))
    found = {}
    if store.exists(where):
        for status in store.listStatus(where):
            name = status.getPath().getName()
            manifest, at = store_of(spark, f"{status.getPath().toString()}/{MANIFEST}")
            if not name.startswith(".") and manifest.exists(at):
                data = manifest.open(at)
                found[name] = json.loads(bytes(data.readAllBytes()))["results"]
                data.close()
    return found


def remove_stagings(spark: SparkSession, root: str, family: str) -> None:
    """Delete what killed jobs have left behind, when no job of this family is
    running."""
    store, where = store_of(spark, versioned_path(root, family, "").rstrip("/"))
    if store.exists(where):
        for status in store.listStatus(where):
            if status.getPath().getName().startswith(STAGING):
                store.delete(status.getPath(), True)
