"""Dimension sources: cell adjacency, cell centres and areas (small CSVs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV ``ADJ_INDEX_1KM, ADJ_1..ADJ_4`` with a fixed schema.
    A header line, if present, would be read as a data row."""
    return spark.read.schema(S.ADJACENCY).csv(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of cell attributes (centres or areas); every column is
    text, as in the source files (no schema inference pass)."""
    return spark.read.option("header", "true").csv(path)
