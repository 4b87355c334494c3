"""Exact deduplication by content sort.

Sampled splitters range-partition the texts, each partition is sorted (Spark's
external sort), so equal texts are adjacent, and each text is compared in full
with its neighbour. The identifier is the last part of the sort key: a group of
any size is spread over as many partitions as it fills, and only the groups
that touch a partition's edge have to be put together afterwards.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches, partition_number, slices, stored

NORMALISE = {"none": lambda text: text,
             "space": lambda text: F.trim(F.regexp_replace(text, r"\s+", " ")),
             "lower": F.lower}

#: Characters of a text that its range splitters hold, beside its hash and id.
SPLITTER_CHARS = 48


def runs(batches):
    """Rows of one sorted partition to rows of runs of equal texts. ``edge``
    marks the first and the last run, which a neighbour partition may go on
    with."""
    part = partition_number()
    ids: list = []
    text, first = None, True

    def closed(edge):
        known = [i for i in ids if i is not None]
        digest = hashlib.sha256(text.encode()).hexdigest()
        for start in range(0, len(ids), 50_000):
            some = ids[start:start + 50_000]
            yield {"doc_id": some, "text_sha256": [digest] * len(some), "part": [part] * len(some),
                   "low": [min(known, default=None)] * len(some),
                   "high": [max(known, default=None)] * len(some),
                   "size": [len(ids)] * len(some), "edge": [edge] * len(some)}

    for batch in slices(batches):
        for doc, row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if row != text:
                if ids:
                    yield from closed(first)
                    first = False
                text, ids = row, []
            ids.append(doc)
    if ids:
        yield from closed(True)


def exact_dedup(df: DataFrame, keep: str = "smallest", normalise: str = "none",
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal (normalised) texts the row with the smallest or largest id stays.
    Null text counts as empty. Rows with a null id are counted, never stay
    unless the whole group has no id, and have a null keep_id then. Repeated
    rows of the id that stays: all are marked kept. Other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    kind = id_type(df, id_col)
    texts = df.select(F.col(id_col).alias("doc_id"),
                      NORMALISE[normalise](F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    head, digest = F.substring("text", 1, SPLITTER_CHARS), F.xxhash64("text")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (texts.repartitionByRange(parts, head, digest, "doc_id")
               .sortWithinPartitions(head, digest, "text", "doc_id"))
    marked = stored(map_batches(
        ordered, runs, f"doc_id {kind}, text_sha256 string, part int, low {kind}, high {kind}, "
                       "size long, edge boolean"), "exact")
    # At most two runs of each partition lie at its edges.
    edges = (marked.where("edge").groupBy("text_sha256", "part")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"),
                  F.first("size").alias("size"))
             .groupBy(F.col("text_sha256").alias("edge_sha256"))
             .agg(F.min("low").alias("all_low"), F.max("high").alias("all_high"),
                  F.sum("size").alias("all_size")))
    one = "low" if keep == "smallest" else "high"
    joined = marked.join(F.broadcast(edges), F.col("edge") & (F.col("text_sha256") == F.col("edge_sha256")),
                         "left")
    return (joined.select(
        "doc_id", F.coalesce(F.when(F.col("edge"), F.col(f"all_{one}")), F.col(one)).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"), "text_sha256")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
