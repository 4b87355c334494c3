"""The corpus preparation pipeline: each stage is one operator of
``cellscope.llm``, reads the documents that the stage before kept, and returns
the documents that it keeps (the last one: packed pieces).

Rows of ``documents`` with nulls, empty texts or repeated ids pass the stages as
each operator's docstring says; columns beside those of ``documents`` are left
out by every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscope.llm import lines, packing, quality, repeats, simhash
from cellscope.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def recounted(docs: DataFrame, *more: str) -> DataFrame:
    """The columns of ``documents``, n_chars after a stage that changed texts,
    and ``more``."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS, *more)


def has_words() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(*COLUMNS), labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line is alike."""
    return recounted(lines.without_duplicate_lines(docs.select(*COLUMNS)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that links within two bits."""
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=3, distance=2)


#: Bytes of a repeated passage: about 50 words.
PASSAGE = 250


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of about 50 words or more that occur
    elsewhere too. A document goes if this takes its last word; one that has
    words left, or lost none, stays."""
    had_words = docs.select(*COLUMNS, has_words().alias("had_words"))
    cut = recounted(repeats.without_repeats(had_words, length=PASSAGE), "had_words")
    return cut.where(~F.col("had_words") | has_words()).select(*COLUMNS)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents, with the checksum of each piece's ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("repeated_passages", repeated_passages),
    ("packing", harmonic_packing),
]

#: No SQL expresses the classifier or the tokenizer; tests compare each stage
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
