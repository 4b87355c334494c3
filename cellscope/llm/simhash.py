"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours differ in few bits.
Groups of neighbours share bits: the bits that all of a group agree on are
factored out into the group's node as a masked pattern, level by level, and
each lower node holds only the bits that its group adds. A search adds up the
differing bits on its way down and leaves out a whole group as soon as the sum
exceeds the distance.

The sorted fingerprints are cut into blocks by sampled splitters, and each block
is searched through its own index. The blocks' top nodes send a fingerprint on
to the following blocks that can hold a partner; sorting once for each part of
the bits keeps these few (see ``linked``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import KEY, id_type, map_batches, rows_with_keys, ship, slices, stored, two_columns
from .components import components

#: Children of an index node.
GROUP = 16
#: Fingerprints searched for at once, and candidate pairs held at once.
QUERY_ROWS, PAIRS = 2048, 1 << 20
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes (XXH64) of the word
    shingles of the lower-cased text; no words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(POWERS[2 * counts > len(hashes)].sum())


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the Gray code: prefix parity of its bits."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index over fingerprints in Gray order. Level 0 holds the fingerprints;
    each level above groups ``GROUP`` nodes and holds the bits that they share
    and no level further up has."""

    def __init__(self, pattern: np.ndarray):
        levels = [(np.full(len(pattern), np.uint64(2**64 - 1)), pattern)]
        while len(levels[-1][0]) > GROUP:
            m, p = levels[-1]
            starts = np.arange(0, len(m), GROUP)
            agree = (np.bitwise_and.reduceat(m, starts)
                     & ~(np.bitwise_or.reduceat(p, starts) ^ np.bitwise_and.reduceat(p, starts)))
            levels.append((agree, p[starts] & agree))
        self.sizes = [len(m) for m, _ in levels]
        self.levels = []
        for below, above in zip(levels, levels[1:] + [None]):
            m, p = below
            if above is not None:
                own = m & ~np.repeat(above[0], GROUP)[:len(m)]
                m, p = own, p & own
            self.levels.append((m, p))

    def search(self, queries: np.ndarray, distance: int):
        """Yields (query number, leaf number) arrays of all leaves within the
        distance, in pieces of bounded size."""
        top = len(self.levels) - 1
        for start in range(0, len(queries), QUERY_ROWS):
            n = min(QUERY_ROWS, len(queries) - start)
            query = np.repeat(np.arange(start, start + n), self.sizes[top])
            node = np.tile(np.arange(self.sizes[top]), n)
            yield from self._down(queries, query, node, np.zeros(len(query), np.uint8), top, distance)

    def _down(self, queries, query, node, spent, level, distance):
        mask, pattern = self.levels[level]
        spent = spent + np.bitwise_count((queries[query] & mask[node]) ^ pattern[node])
        near = spent <= distance
        query, node, spent = query[near], node[near], spent[near]
        if level == 0:
            if len(query):
                yield query, node
            return
        step = PAIRS // GROUP
        for at in range(0, len(query), step):
            some = slice(at, at + step)
            child = (node[some, None] * GROUP + np.arange(GROUP)).ravel()
            real = child < self.sizes[level - 1]
            yield from self._down(queries, np.repeat(query[some], GROUP)[real], child[real],
                                  np.repeat(spent[some], GROUP)[real], level - 1, distance)


class Forest:
    """Union-find over the leaves of one block."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        up = self.parent[nodes]
        while True:
            further = self.parent[up]
            if (further == up).all():
                return up
            up = further

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs: hang the larger root on the smaller one until none differ."""
        while True:
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(ra[differ], rb[differ]), np.maximum(ra[differ], rb[differ])
            np.minimum.at(self.parent, high, low)


def fingerprints(rows: DataFrame, shingle: int, more: str) -> DataFrame:
    """The columns ``more`` of ``rows`` (which has ``text`` beside them) and fp,
    the 64 bits as a signed long, of every row."""
    names = T.StructType.fromDDL(more).fieldNames()

    def work(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield {c: batch.column(c) for c in names} | {"fp": found.view(np.int64)}

    return map_batches(rows, work, f"{more}, fp long")


def turned(fp: np.ndarray, by: int) -> np.ndarray:
    """The 64 bits turned to the left."""
    return fp if by % 64 == 0 else (fp << np.uint64(by % 64)) | (fp >> np.uint64(64 - by % 64))


def linked(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect
    what is within the distance: for a fingerprint and a block, one edge to
    each group that the block's own links connect, not one per pair.

    Of ``distance + 1`` parts of the bits, two linked fingerprints agree in
    one. So they are sorted once for each part, with that part turned to the
    top: partners then share the leading bits in one of the orders, and stand
    in one block, or in neighbouring ones when a group with the same leading
    bits is cut.
    """
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [turn * 64 // (distance + 1) for turn in range(distance + 1)]
    beyond = np.uint64(64 - 64 // (distance + 1))  # bits after the leading ones
    top_bit = np.uint64(1 << 63)  # flipped, signed order is the order of the ranks

    def ranks(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for turn, step in enumerate(steps):
                own = turned(fp, step)
                yield {"turn": np.full(len(fp), turn, np.int64), "fp": own.view(np.int64),
                       "gray": (gray_rank(own) ^ top_bit).view(np.int64)}

    ordered = (map_batches(distinct.select("fp"), ranks, "turn long, fp long, gray long")
               .repartitionByRange(parts, "turn", "gray").sortWithinPartitions("turn", "gray"))
    table = stored(ordered.select("turn", "fp", "gray", F.expr("turn * (1L << 32) + spark_partition_id()")
                                  .alias("block")), "gray")
    # One row per block: the bits that all its fingerprints share.
    roots = (table.groupBy("block").agg(F.expr("bit_and(fp)").alias("ones"), F.expr("bit_or(fp)").alias("some"),
                                        F.min("gray").alias("first")).orderBy("block").collect())
    ones, some, first = (np.array([r[c] for r in roots], np.int64).view(np.uint64) for c in ("ones", "some", "first"))
    numbers = np.array([r.block for r in roots], np.int64)
    nodes = spark.sparkContext.broadcast((numbers, ones, ~(ones ^ some), (first ^ top_bit) >> beyond))

    def visit(batches):
        numbers, ones, mask, leading = nodes.value
        for batch in batches:
            fp, gray, home = (batch.column(c).to_numpy() for c in ("fp", "gray", "block"))
            fp, own = fp.view(np.uint64), (gray.view(np.uint64) ^ top_bit) >> beyond
            at = np.searchsorted(numbers, home) + 1
            # Later blocks of the same order that begin with the same leading bits.
            row = np.arange(len(fp))
            while len(row):
                row, at = row[at < len(numbers)], at[at < len(numbers)]
                same = (numbers[at] >> 32 == home[row] >> 32) & (leading[at] == own[row])
                row, at = row[same], at[same]
                near = np.bitwise_count((fp[row] ^ ones[at]) & mask[at]) <= distance
                if near.any():
                    yield {"fp": fp[row[near]].view(np.int64), "block": numbers[at[near]]}
                at = at + 1

    visitors = map_batches(table.select("fp", "gray", "block"), visit, "fp long, block long")
    ship(spark)
    shape = T.StructType.fromDDL("a long, b long")
    arrow = to_arrow_schema(shape)

    def search(own: pa.Table, guests: pa.Table) -> pa.Table:
        if not own.num_rows:
            return arrow.empty_table()
        own = own.sort_by("gray")
        fp = own.column("fp").to_numpy().view(np.uint64)
        index, forest = GrayIndex(fp), Forest(len(fp))
        for query, leaf in index.search(fp, distance):
            forest.join(query, leaf)
        root = forest.roots(np.arange(len(fp)))
        inside = root != np.arange(len(fp))
        a, b = [fp[inside]], [fp[root[inside]]]
        if guests.num_rows:
            guest = guests.column("fp").to_numpy().view(np.uint64)
            for query, leaf in index.search(guest, distance):
                pairs = np.unique(query * np.int64(len(fp)) + root[leaf])
                a.append(guest[pairs // len(fp)])
                b.append(fp[pairs % len(fp)])
        back = 64 - steps[own.column("block")[0].as_py() >> 32]
        return pa.table([pa.array(turned(np.concatenate(x), back).view(np.int64)) for x in (a, b)], schema=arrow)

    return (table.select("fp", "gray", "block").groupBy("block")
            .cogroup(visitors.groupBy("block")).applyInArrow(search, shape))


def named(prints: DataFrame, distance: int, name: Column) -> DataFrame:
    """Every fingerprint (fp) with the least ``name`` of a row of its component
    (column ``name``). Rows of one fingerprint are merged before any shuffle."""
    least = prints.groupBy("fp").agg(F.min(name).alias("least"))
    found = components(linked(least.select("fp"), distance))
    groups = least.join(found, least.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    groups = stored(groups, "groups")
    names = groups.groupBy("component").agg(F.min("least").alias("name"))
    return groups.join(names, "component").select("fp", "name")


def near_duplicates(df: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits),
    component_id: the smallest doc_id reachable over links between fingerprints
    that differ in ``distance`` bits or fewer.

    Null and empty texts have fingerprint zero and link like any other. Equal
    fingerprints are one node, so groups of copies of any size add one node.
    Repeated rows give a row each. Rows with a null id are linked, but name no
    component unless nothing else is in it (then null). Other columns are not
    read.
    """
    prints = stored(fingerprints(two_columns(df, id_col, text_col), shingle, f"doc_id {id_type(df, id_col)}"),
                    "fingerprints")
    found = named(prints, distance, F.col("doc_id"))
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           F.col("name").alias("component_id"))


def one_of_each(df: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Exactly one row of ``df`` per component, all columns unchanged: the row
    of least id (null last). Rows with the same id are ordered by hashes of
    their text, then of all their columns; of rows equal in all of them one
    stays. Rows are told apart by these hashes (160 bits), not by their id.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    keys = ["k1", "k2", "k3"]
    rows = rows_with_keys(df, id_col, text_col).withColumn(
        "k3", F.xxhash64(F.lit("row"), *(F.col(f"row.`{c}`") for c in plain)))
    prints = stored(fingerprints(rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), "text", *keys), shingle,
                                 f"doc_id {id_type(df, id_col)}, {KEY}, k3 long"), "fingerprints")
    found = named(prints, distance, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys))
    # Keys of which not every row stays; most rows have none, and are not shuffled if these are few.
    less = stored(prints.join(found, "fp").groupBy(*keys, F.expr(
        "k1 = name.k1 AND k2 = name.k2 AND k3 = name.k3").alias("stays")).count()
        .where("NOT stays OR count > 1"), "less")
    whole = rows.join(less.select(*keys), keys, "left_anti")
    copies = rows.join(less.where("stays").select(*keys), keys, "left_semi").dropDuplicates(keys)
    return whole.unionByName(copies).select(*(F.col(f"row.`{c}`") for c in df.columns))
