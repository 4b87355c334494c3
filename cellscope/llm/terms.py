"""Per-document term frequencies in blocks.

A task reads its documents in blocks of bounded size. A block is written as one
row of frequencies (document x local term number, compressed) and, for each
bucket of terms, one row with the block's distinct terms of that bucket. Values
of terms (token counts, corpus counts) are found once per distinct term, join
back to the block by (block, bucket), and each block sums them per document.
So what is shuffled grows with distinct terms per block, not with tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_type, map_batches, partition_number, ship, slices, stored, two_columns

#: Rows and bytes of text in a block at most (a longer text is its own block).
BLOCK_ROWS, BLOCK_BYTES = 20_000, 24 << 20


def squeeze(array: np.ndarray) -> bytes:
    """Integers as zstd of their byte planes, which compresses small values well."""
    planes = array.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def steps(numbers: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Each document's rising numbers as differences, which are small."""
    out = np.diff(numbers, prepend=0)
    first = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    out[first] = numbers[first]
    return out


def unsteps(differences: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    total = np.cumsum(differences)
    first = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    return total - np.repeat(total[first] - differences[first], per_doc[per_doc > 0])


class Terms(dict):
    """Local numbers of a block's terms, in order of appearance."""

    def __missing__(self, term):
        number = self[term] = len(self)
        return number


def one_by_one(numbers_of: Callable) -> Callable:
    """For ``blocks``, a function that numbers the terms of a single text."""
    return lambda texts, terms: [np.asarray(numbers_of(t, terms), np.int64) for t in texts]


def frequencies(numbers: list[np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs in order: pairs per document, term, count."""
    sizes = [len(n) for n in numbers]
    key = np.repeat(np.arange(len(numbers), dtype=np.int64) * kinds, sizes) + (
        np.concatenate(numbers) if numbers else np.zeros(0, np.int64))
    pairs, counts = np.unique(key, return_counts=True)
    return (np.bincount(pairs // max(1, kinds), minlength=len(numbers)),
            pairs % max(1, kinds), counts)


def blocks(df: DataFrame, numberer: Callable, buckets: int, id_col: str, text_col: str,
           train: Callable[[list, list], np.ndarray] | None = None,
           packed: Callable[[list], bytes] | None = None, name: str = "terms") -> DataFrame:
    """The stored block table: block, bucket (null in the row of frequencies),
    doc_ids, sizes, packed, per_doc, numbers, counts, terms, train_counts.

    ``numberer()`` makes a function (texts of a block, Terms) -> arrays of the
    local term numbers of each text. ``train(ids, texts)`` says which documents of a block count in
    ``train_counts``; ``packed(texts)`` is kept with the block.
    """
    kind = id_type(df, id_col)

    def work(batches: Iterable[pa.RecordBatch]):
        numbers_of = numberer()
        part = partition_number()
        held, size, seq = [], 0, 0

        def block_rows():
            ids = [i for batch in held for i in batch.column("doc_id").to_pylist()]
            texts = [t for batch in held for t in batch.column("text").to_pylist()]
            terms = Terms()
            numbers = numbers_of(texts, terms)
            kinds = len(terms)
            # Terms are numbered bucket by bucket.
            spelled = list(terms)
            bucket = np.fromiter((zlib.crc32(t) % buckets for t in spelled), np.int64, kinds)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(kinds, np.int64)
            place[order] = np.arange(kinds)
            per_doc, which, counts = frequencies([place[n] for n in numbers], kinds)
            trained = np.zeros(kinds, np.int64)
            if train is not None:
                used = np.repeat(train(ids, texts), per_doc)
                trained = np.bincount(which[used], counts[used], minlength=kinds).astype(np.int64)
            sizes = [len(t.encode()) for t in texts]
            number = part << 32 | seq
            none = {"doc_ids": None, "sizes": None, "packed": None, "per_doc": None, "numbers": None, "counts": None,
                    "terms": None, "train_counts": None}
            yield none | {"block": number, "bucket": None, "doc_ids": ids, "sizes": sizes,
                          "packed": None if packed is None else packed(texts),
                          "per_doc": squeeze(per_doc), "numbers": squeeze(steps(which, per_doc)),
                          "counts": squeeze(counts)}
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                chosen = order[edges[b]:edges[b + 1]]
                if len(chosen):
                    yield none | {"block": number, "bucket": b, "terms": [spelled[i] for i in chosen],
                                  "train_counts": None if train is None else trained[edges[b]:edges[b + 1]].tolist()}

        def closed():
            rows = list(block_rows())
            for start in range(0, len(rows), 64):
                yield {c: [r[c] for r in rows[start:start + 64]] for c in rows[0]}

        for batch in slices(batches):
            more = batch.column("text").nbytes
            if held and (size + more > BLOCK_BYTES or sum(b.num_rows for b in held) >= BLOCK_ROWS):
                yield from closed()
                held, size, seq = [], 0, seq + 1
            held.append(batch)
            size += more
        if held:
            yield from closed()

    return stored(map_batches(
        two_columns(df, id_col, text_col), work,
        f"block long, bucket int, doc_ids array<{kind}>, sizes array<long>, packed binary, "
        "per_doc binary, "
        "numbers binary, counts binary, terms array<binary>, train_counts array<long>"), name)


def per_document(table: DataFrame, values: DataFrame, combine: Callable, schema: str) -> DataFrame:
    """Joins ``values`` to the blocks: either (block, bucket, values: an array
    per term of the bucket) or (block, bucket, at, value). ``combine(row,
    values, per_doc, numbers, counts)`` makes the columns of ``schema`` from a
    block's row of frequencies."""
    ship(table.sparkSession)
    shape = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape)
    single = "value" in values.columns
    left = (table.where("bucket IS NULL").drop("bucket", "terms", "train_counts")
            .withColumnRenamed("block", "own"))

    def together(rows: pa.Table, found: pa.Table) -> pa.Table:
        if single:
            flat = found.sort_by([("bucket", "ascending"), ("at", "ascending")]).column("value").to_numpy()
        else:
            ordered = found.sort_by("bucket").column("values")
            flat = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in ordered.chunks)])
        out = []
        for row in rows.to_pylist():  # one row per block
            per_doc, numbers, counts = (unsqueeze(row[c]).astype(np.int64)
                                        for c in ("per_doc", "numbers", "counts"))
            columns = combine(row, flat, per_doc, unsteps(numbers, per_doc), counts)
            out.append(pa.table([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    return left.groupBy("own").cogroup(values.groupBy("block")).applyInArrow(together, shape)


def summed(per_doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``weights``, one per document."""
    total = np.concatenate([np.zeros(1, weights.dtype), np.cumsum(weights)])
    ends = np.cumsum(per_doc)
    return total[ends] - total[ends - per_doc]
