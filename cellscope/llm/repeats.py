"""Removal of repeated passages by sparse, distributed prefix doubling.

A suffix array tells which byte strings of a given length occur twice; prefix
doubling builds it by sorting (rank, rank at a growing offset) pairs, round by
round, and a suffix leaves as soon as its rank is unique. Here the rounds run
over *content-chosen* positions instead of all bytes, so that what Spark sorts
is a small multiple of (bytes / length):

* The string at byte p is filed under its anchor, the ``GRAM``-byte gram of
  least hash within it. Equal strings have the same anchor at the same
  distance. Consecutive positions with the same anchor form one record.
* Each round gives a record two ranks: that of the string all its positions
  share (``core``, growing round by round up to the full length) and that of
  everything they span (``full``). A unique core leaves: nothing repeats. A
  repeated full rank leaves: everything repeats. What is left is cut into
  smaller ranges of positions, whose cores are longer, and ranked again, until
  a range is one position and its core the whole string.

Ranks are 64- and 128-bit fingerprints; equal ones are brought together by
Spark's sort-based grouping and joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (KEY, keyed, map_batches, release, rewritten, rows_with_keys, slices, stored,
                     with_row)

#: Bytes of an anchor gram; bytes of text per numpy step; ranges per cut.
GRAM, STEP, FAN_OUT = 32, 1 << 18, 8

MASK = 2**64 - 1
#: Odd multipliers for mixing and for two polynomial fingerprints.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << (max(n, 2) - 1).bit_length()
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            both.append(np.cumprod(p))
        known = _powers[base] = (both[0], both[1])
    return known[0][:n], known[1][:n]


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x * MIX[k]
    x ^= x >> np.uint64(32)
    x *= MIX[(k + 1) % 4]
    x ^= x >> np.uint64(29)
    return x


class Fingerprints:
    """Fingerprints of any substring (of eight bytes or more) of one byte
    array: differences of prefix sums of mixed 8-byte words."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = mixed(np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (n,), (1,)), 0)
        self.sums = []
        for base in BASES:
            up, down = powers(base, n + 1)
            self.sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])]), down))

    def of(self, start: np.ndarray, length: np.ndarray, which: int) -> np.ndarray:
        sums, down = self.sums[which]
        value = (sums[start + length - 7] - sums[start]) * down[start]
        return mixed(value + length.astype(np.uint64), 3)

    def grams(self, gram: int) -> np.ndarray:
        """Those of all substrings of ``gram`` bytes."""
        sums, down = self.sums[0]
        n = len(sums) - gram
        value = (sums[gram - 7:gram - 7 + n] - sums[:n]) * down[:n]
        return mixed(value + np.uint64(gram), 3)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, from running minima within blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.uint64(MASK))
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def records(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Records of the positions that each ``starts:ends`` stretch has room
    for: (stretch, first, last, anchor) as indices into ``data``, and ranks."""
    low = np.uint64(0xFFFFFFFF)
    prints = Fingerprints(data)
    order = prints.grams(gram)
    at = np.arange(len(order))
    anchor = (window_minimum((order & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    inside[starts] += 1
    inside[ends - length + 1] -= 1
    position = np.flatnonzero(np.cumsum(inside)[:len(anchor)] > 0)
    chosen = anchor[position]
    stretch = np.searchsorted(starts, position, "right") - 1
    new = np.flatnonzero(np.r_[True, (np.diff(chosen) != 0) | (np.diff(stretch) != 0)])
    first, last = position[new], position[np.r_[new[1:], len(position)] - 1]
    return (stretch[new], first, last, chosen[new], order[chosen[new]].view(np.int64),
            *spans_of(prints, first, last, chosen[new], length))


def spans_of(prints: Fingerprints, first, last, anchor, length):
    """The 128-bit full rank: all bytes that the range spans, and where the
    anchor lies in it."""
    size = last - first + length
    place = mixed((anchor - first).astype(np.uint64) * MIX[2] + (anchor - last).astype(np.uint64), 1)
    return tuple((prints.of(first, size, k) ^ (place * MIX[k])).view(np.int64) for k in (0, 1))


def first_records(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Records of all documents, one for each rank within a numpy step. Where
    a rank occurs twice in the step, its positions are known to repeat: the
    merged ranges are given as rows without ranks, and the record itself
    (``weight`` 2, not ``open``) is there for comparison only."""
    def stretches(batch):
        """(rows, first bytes, byte arrays) in steps of bounded size; a long
        text is cut into stretches that overlap by length - 1."""
        rows, firsts, parts, held = [], [], [], 0
        for row, text in enumerate(batch.column("text").to_pylist()):
            raw = text.encode()
            for start in range(0, len(raw) - length + 1, STEP):
                part = raw[start:start + STEP + length - 1]
                rows.append(row)
                firsts.append(start)
                parts.append(part)
                held += len(part)
                if held >= STEP:
                    yield rows, firsts, parts
                    rows, firsts, parts, held = [], [], [], 0
        if rows:
            yield rows, firsts, parts

    def work(batches):
        for batch in slices(batches):
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for rows, firsts, parts in stretches(batch):
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                data = np.frombuffer(b"".join(parts), np.uint8)
                which, first, last, anchor, core, f1, f2 = records(data, starts, ends, length, gram)
                row, shift = np.array(rows)[which], np.array(firsts)[which] - starts[which]
                _, one, inverse, count = np.unique(f1, return_index=True, return_inverse=True,
                                                   return_counts=True)
                again = count[inverse] > 1
                yield {"k1": k1[row[one]], "k2": k2[row[one]], "first": (first + shift)[one],
                       "last": (last + shift)[one], "anchor": (anchor + shift)[one], "core": core[one],
                       "f1": f1[one], "f2": f2[one], "weight": np.where(again[one], 2, 1).astype(np.int32),
                       "open": ~again[one]}
                sure = np.flatnonzero(again)
                if len(sure):
                    new = np.r_[True, (np.diff(sure) != 1) | (np.diff(which[sure]) != 0)]
                    begin, end = sure[new], sure[np.r_[np.flatnonzero(new)[1:], len(sure)] - 1]
                    none = pa.nulls(len(begin), pa.int64())
                    yield {"k1": k1[row[begin]], "k2": k2[row[begin]], "first": (first + shift)[begin],
                           "last": (last + shift)[end], "anchor": none, "core": none, "f1": none, "f2": none,
                           "weight": pa.nulls(len(begin), pa.int32()), "open": np.zeros(len(begin), bool)}

    return map_batches(docs, work, f"{KEY}, first long, last long, anchor long, core long, f1 long, "
                                   "f2 long, weight int, open boolean")


def ranked(table: DataFrame, last_round: bool) -> tuple[DataFrame, DataFrame | None]:
    """One round: (ranges of which every position repeats, one range of each
    rank that has to be cut further). ``open`` ranges are still undecided; the
    others are there for comparison only."""
    shared = (table.groupBy("core")
              .agg(F.min("f1").alias("least"), F.max("f1").alias("most"),
                   F.sum("weight").alias("all"), F.max("open").alias("wanted"))
              .where("wanted AND all > 1").select("core", (F.col("least") != F.col("most")).alias("mixed")))
    live = stored(table.join(shared, "core"), "live")
    whole = [c for c in table.columns if c not in ("core", "f1", "f2")]
    classes = live.groupBy("f1", "f2").agg(F.sum("weight").alias("n"), F.first("mixed").alias("mixed"),
                                           F.min(F.struct("core", *whole)).alias("one"))
    repeated = (live.where("open").join(classes.where("n > 1").select("f1", "f2"), ["f1", "f2"])
                .select("k1", "k2", "first", "last"))
    if last_round:
        return stored(repeated, "repeated"), None
    rest = (classes.where("mixed").withColumn("open", F.expr("one.open AND n = 1"))
            .select("open", "one.core", *(f"one.{c}" for c in whole if c not in ("open", "weight")),
                    F.when(F.col("open"), 1).otherwise(2).cast("int").alias("weight")))
    # Only ranges that share their core with an undecided one go on.
    wanted = rest.where("open").select("core").distinct()
    out = stored(repeated, "repeated"), stored(rest.join(wanted, "core", "left_semi"), "rest")
    release(live)
    return out


def contexts(docs: DataFrame, rest: DataFrame, length: int) -> DataFrame:
    """The bytes that each range spans, from document byte ``origin`` on,
    fetched from its document; the requests of a document are bounded by its
    length."""
    wanted = rest.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("first", "last", "anchor", "open", "weight")).alias("ranges"))
    pairs = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"])

    def work(batches):
        for batch in slices(batches):
            for k1, k2, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "ranges"))):
                raw = text.encode()
                for at in range(0, len(ranges), 2000):
                    some = ranges[at:at + 2000]
                    yield {"k1": [k1] * len(some), "k2": [k2] * len(some),
                           "origin": [r["first"] for r in some],
                           "bytes": [raw[r["first"]:r["last"] + length] for r in some]} | {
                        c: [r[c] for r in some] for c in ("first", "last", "anchor", "open", "weight")}

    return map_batches(pairs, work, f"{KEY}, origin long, first long, last long, anchor long, "
                                    "open boolean, weight int, bytes binary")


def cells(spanned: DataFrame, size: int, length: int) -> DataFrame:
    """Ranges cut at fixed distances from their anchors, ``size`` positions
    each, and the ranks of the pieces."""
    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield cut(batch.slice(start, 512))

    def cut(batch):
        col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in
               ("k1", "k2", "origin", "first", "last", "anchor", "open", "weight")}
        parts = batch.column("bytes").to_pylist()
        sizes = np.array([len(p) for p in parts])
        base = np.cumsum(sizes) - sizes - col["origin"]  # document byte to index in data
        prints = Fingerprints(np.frombuffer(b"".join(parts), np.uint8))
        near, far = col["anchor"] - col["last"], col["anchor"] - col["first"]
        count = far // size - near // size + 1
        row = np.repeat(np.arange(batch.num_rows), count)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (near // size)[row]
        shared = col["anchor"][row] - cell * size  # the bytes common to a whole cell begin here
        last = np.minimum(col["last"][row], shared)
        first = np.maximum(col["first"][row], shared - size + 1)
        at = base[row]
        core = prints.of(shared + at, np.full(len(row), length - size + 1), 0)
        core = mixed(core + cell.astype(np.uint64) * MIX[0], 1).view(np.int64)
        f1, f2 = spans_of(prints, first + at, last + at, col["anchor"][row] + at, length)
        return {"core": core, "f1": f1, "f2": f2, "first": first, "last": last} | {
            c: col[c][row] for c in ("k1", "k2", "origin", "anchor", "open", "weight")}

    return map_batches(spanned, work, f"{KEY}, origin long, first long, last long, anchor long, core long, "
                                      "f1 long, f2 long, weight int, open boolean")


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """Ranges (k1, k2, first, last) of all positions whose ``length``-byte
    string also starts anywhere else."""
    gram = min(GRAM, length // 2)
    found = stored(first_records(docs, length, gram), "records")
    ranges = [found.where("NOT open").select("k1", "k2", "first", "last")]
    repeated, rest = ranked(found.where("core IS NOT NULL").withColumn("origin", F.col("first")), False)
    ranges.append(repeated)
    spanned = kept = stored(contexts(docs, rest, length), "contexts")
    release(rest)
    size = length - gram + 1
    while size > 1:
        size = -(-size // FAN_OUT)
        table = stored(cells(spanned, size, length), "cells")
        repeated, rest = ranked(table, size == 1)
        release(table)
        ranges.append(repeated)
        if rest is not None:
            spanned = rest.join(kept.select("k1", "k2", "origin", "bytes"), ["k1", "k2", "origin"])
    release(kept)
    whole = ranges[0]
    for more in ranges[1:]:
        whole = whole.unionByName(more)
    return whole


def cut_out(raw: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, as (start, end), and the bytes that remain."""
    runs: list[list[int]] = []
    for first, last in sorted(ranges):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + length)
        else:
            runs.append([first, last + length])
    edges = [0, *(e for run in runs for e in run), len(raw)]
    return [tuple(r) for r in runs], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def grouped(ranges: DataFrame, name: str = "ranges") -> DataFrame:
    """(k1, k2, ranges) of the texts that have any."""
    return ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias(name))


def checked(length: int) -> int:
    if length < 16:
        raise ValueError("repeated strings have at least 16 bytes")
    return length


def with_ranges(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """The rows of ``df`` as struct ``row``, with text and repeated ranges."""
    ranges = repeated_ranges(keyed(df, id_col, text_col), checked(length))
    return rows_with_keys(df, id_col, text_col).join(grouped(ranges), ["k1", "k2"], "left")


def passages(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n_passage, longest): bytes that ``length``-byte strings which
    start elsewhere too cover in a text, and in its longest run of them."""
    def work(batches):
        for batch in batches:
            runs = [cut_out(b"", [(r["first"], r["last"]) for r in ranges], length)[0]
                    for ranges in batch.column("ranges").to_pylist()]
            yield {"k1": batch.column("k1"), "k2": batch.column("k2"),
                   "n_passage": [sum(b - a for a, b in own) for own in runs],
                   "longest": [max(b - a for a, b in own) for own in runs]}

    return stored(map_batches(grouped(repeated_ranges(docs, checked(length))), work,
                              f"{KEY}, n_passage long, longest long"), "passages")


def remove_repeats(df: DataFrame, length: int = 400, passage: int = 250, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans
    (array of start, end), kept (bytes), n_passage.

    ``n_passage`` counts the bytes that shorter repeated strings, of ``passage``
    bytes (about 50 words), cover; these are only reported, not removed. A string
    of ``length`` bytes repeats only where its shorter ones do, so the long ones
    are looked for in the texts that have a long enough run of short ones.

    Every byte covered by a ``length``-byte string of the same or another text
    that also starts elsewhere is removed; strings are judged on the input.
    Texts are UTF-8, null counts as empty; texts shorter than ``length`` lose
    nothing. A repeated row is another document, so both lose all that is long
    enough. Null ids give a row each; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = keyed(base, "doc_id", "text")
    short = passages(docs, min(passage, length))
    long = docs.join(short.where(F.col("longest") >= length).select("k1", "k2"), ["k1", "k2"], "left_semi")
    found = short.select("k1", "k2", "n_passage").join(
        grouped(repeated_ranges(long, checked(length))), ["k1", "k2"], "left")
    rows = (rows_with_keys(base, "doc_id", "text").join(found, ["k1", "k2"], "left")
            .select(F.col("row.doc_id").alias("doc_id"), "text", "ranges", "n_passage"))

    def work(batches):
        for batch in slices(batches, max_rows=500):
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            cuts = [cut_out(raw, [(r["first"], r["last"]) for r in ranges or ()], length)
                    for raw, ranges in zip(raws, batch.column("ranges").to_pylist())]
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(r) for r in raws],
                   "n_removed": [len(r) - len(kept) for r, (_, kept) in zip(raws, cuts)],
                   "n_spans": [len(runs) for runs, _ in cuts],
                   "spans": [[{"start": a, "end": b} for a, b in runs] for runs, _ in cuts],
                   "kept": [kept for _, kept in cuts],
                   "n_passage": [n or 0 for n in batch.column("n_passage").to_pylist()]}

    return map_batches(rows, work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, "
                                   "spans array<struct<start:long,end:long>>, kept binary, n_passage long")


def without_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with the repeated bytes cut out of the
    text. A character that is cut in two goes altogether."""
    rows = with_ranges(df, id_col, text_col, length).select("row", "text", "ranges")

    def work(batches):
        for batch in slices(batches, max_rows=500):
            texts = [cut_out(t.encode(), [(r["first"], r["last"]) for r in ranges], length)[1].decode(errors="ignore")
                     if ranges else t
                     for t, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist())]
            yield {"row": batch.column("row"), "new_text": texts}

    return rewritten(df, map_batches(rows, work, with_row(df, "new_text string")), text_col)
