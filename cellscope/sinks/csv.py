"""CSV outputs and the versioned output layout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, single_file: bool = False,
              mode: str = "errorifexists", header: bool = True) -> None:
    """CSV with a header line. ``single_file`` writes one part file, for small
    results: the rows are computed in as many tasks as ever and only the
    finished result goes through one writer. The default mode refuses to
    overwrite an existing result."""
    out = df.repartition(1) if single_file else df
    out.write.mode(mode).option("header", str(header).lower()).csv(path)


def read_csv(spark: SparkSession, path: str, casts: Mapping[str, str] | None = None) -> DataFrame:
    """Read a header CSV back (all text), casting the named columns. An
    empty string and a null both come back as null."""
    df = spark.read.option("header", "true").csv(path)
    for c, t in (casts or {}).items():
        df = df.withColumn(c, df[c].cast(t))
    return df


def versioned_path(root: str, family: str, version: str | int, *parts: str) -> str:
    """``{root}/output/{family}/{version}/{parts...}``, the layout of every
    job's results (e.g. family ``tc`` for temporal, ``sc`` for spatial)."""
    return "/".join([root.rstrip("/"), "output", family, str(version), *map(str, parts)])


def write_intermediates(tables: Mapping[str, DataFrame], debug_path: str | None,
                        mode: str = "errorifexists") -> None:
    """Write named intermediate tables under ``debug_path`` (no-op when None)."""
    if not debug_path:
        return
    for name, df in tables.items():
        write_csv(df, f"{debug_path.rstrip('/')}/{name}", mode=mode)
