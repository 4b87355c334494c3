"""Context-tree weighting over whole bytes, with its counts in Spark tables.

A gram is one number: the ``DEPTH`` bytes before a byte, nearest first, and the
byte itself in the lowest place. In the order of grams the contexts of every
depth are ranges, so the tree of a whole corpus is a sorted table of grams and
their training counts, cut into ranges of about ``RANGE_GRAMS``. It grows with
the corpus and is never gathered.

1. Each block of texts asks for its distinct grams, sorted in runs; grams of
   texts that only are scored ask with count 0.
2. Bottom-up: a range puts the requests together once and is stored as one row:
   its distinct grams, their counts, and which of them each block asked for. It
   has the weights of all contexts that lie within it. Of the contexts that a cut
   runs through, at most ``2 * (DEPTH + 1)`` a range, it gives its share of the
   counts and weights; Spark adds the shares up by (context, node), one depth
   after the other (``put_together``).
3. Top-down: a range gets the nodes of its cut contexts back by a join, mixes
   all depths and answers every request with the gram's code length; the block
   sums them per text.

The driver holds the cuts: one number per range.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_batches, release, ship, stored
from .terms import squeeze, unsqueeze

#: Bytes of the longest context, the order of the model: with the byte itself
#: they fill the 64 bits of a gram.
DEPTH = 7
#: Asked grams of a range, about, and the share of grams that cuts are chosen from.
RANGE_GRAMS, SAMPLED = 1 << 20, 1 << 16
#: Bytes of a block's text whose grams are looked up at once, and of those that
#: are sorted at once (in place: eight bytes each).
STEP, RUN = 1 << 20, 12 << 20


def pack(raws: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(raws))


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)


def squeeze_grams(grams: np.ndarray) -> bytes:
    planes = np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze_grams(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze_counts(counts: np.ndarray) -> bytes:
    """Sums of many blocks may pass 32 bits."""
    planes = counts.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def grams(data: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Of the bytes a to b; what lies before a text (``starts``) is byte 0."""
    before = min(a, DEPTH)
    raw = bytes(DEPTH - before) + data[a - before:b].tobytes() + bytes(8)
    found = np.empty(b - a, np.uint64)
    for k in range(8):  # eight bytes read at every place, the byte itself last
        every = found[k::8]
        every[:] = np.frombuffer(raw, "<u8", count=len(every), offset=k)
    found = (found << np.uint64(8)) | (found >> np.uint64(56))
    for near in range(DEPTH):  # so many bytes after a text's start only they are its own
        at = starts + near - a
        own = ((1 << 8 * near) - 1) << (64 - 8 * near) | 255
        found[at[(at >= 0) & (at < b - a)]] &= np.uint64(own)
    return found


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def texts_of(ends: np.ndarray, a: int, b: int) -> np.ndarray:
    """Of the bytes a to b: the number of the text that each is in."""
    first, last = np.searchsorted(ends, (a, b - 1), "right")
    return np.repeat(np.arange(first, last + 1), np.diff(np.r_[a, ends[first:last], b]))


def distinct(counted: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of both in order and how often ``counted`` has them. The
    arrays are sorted in place."""
    counted.sort()
    first = firsts(counted)
    n, some = np.diff(np.append(first, len(counted))), counted[first]
    scored.sort()
    more = scored[firsts(scored)]
    at = np.searchsorted(some, more)
    new = np.ones(len(more), bool)
    inside = at < len(some)
    new[inside] = some[at[inside]] != more[inside]
    return np.insert(some, at[new], more[new]), np.insert(n, at[new], 0)


def merged(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, with their counts added up."""
    g = np.concatenate([np.zeros(0, np.uint64), *found])
    order = np.argsort(g, kind="stable")
    g, n = g[order], np.concatenate([np.zeros(0, np.int64), *counts])[order]
    first = firsts(g)
    return g[first], np.add.reduceat(n, first) if len(g) else n


def united(found: list[np.ndarray]) -> tuple[np.ndarray]:
    """``merged`` without counts."""
    g = np.concatenate([np.zeros(0, np.uint64), *found])
    g.sort()
    return g[firsts(g)],


class Merging:
    """Distinct grams of many runs (put together by ``merged`` or ``united``), of
    which as few are held as can be: sets of about the same size are merged, as
    in a counter."""

    def __init__(self, merge=merged):
        self.merge, self.held = merge, []

    def add(self, *found: np.ndarray) -> None:
        self.held.append(found)
        while len(self.held) > 1 and 2 * len(self.held[-1][0]) > len(self.held[-2][0]):
            self.held[-2:] = [self.merge(*zip(*self.held[-2:]))]

    def all(self) -> tuple[np.ndarray, ...]:
        while len(self.held) > 1:
            self.held[-2:] = [self.merge(*zip(*self.held[-2:]))]
        return self.held[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5, by Stirling's series after eight steps up."""
    steps = np.ones_like(x)
    for step in range(8):
        steps *= x + step
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(steps)


#: Counts below this have their estimates in a table.
SMALL = 128


def computed_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    z, o = zeros.astype(float), ones.astype(float)
    return log_gamma(z + .5) + log_gamma(o + .5) - np.log(np.pi) - log_gamma(z + o + 1)


@functools.cache
def kt_table() -> np.ndarray:
    return computed_kt(*np.indices((SMALL, SMALL))).ravel()


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of the counts (integers)."""
    small = (zeros < SMALL) & (ones < SMALL)
    out = kt_table()[np.where(small, zeros * SMALL + ones, 0)]
    large = np.flatnonzero(~small)
    if len(large):
        out[large] = computed_kt(zeros[large], ones[large])
    return out


def mixed(alone: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of nodes, half their own estimate's and
    half that of the longer contexts, and the share of the own one."""
    weighted = np.logaddexp(alone, below) - math.log(2)
    return weighted, np.exp(alone - math.log(2) - weighted)


def prefix(gram: int, depth: int) -> int:
    """The context of ``depth`` bytes that a gram begins with."""
    return gram >> (64 - 8 * depth)


class Level:
    """The (context, byte) pairs of one depth in a range, in order."""

    def __init__(self, d: int, entries: np.ndarray, counts: np.ndarray, low: int, high: int):
        self.d, self.entries, self.counts = d, entries, counts
        self.byte = ((entries >> np.uint64(56 - 8 * d)) & np.uint64(255)).astype(np.uint8)
        apart = entries[1:] ^ entries[:-1]
        top = np.frexp((apart & ~(apart >> np.uint64(1))).astype(float))[1]  # exact: no carry from below
        #: Bits that an entry shares with the one before it.
        self.shared = np.r_[-1, 64 - top].astype(np.int8)[:len(entries)]
        self.sums = np.r_[0, np.cumsum(counts)]
        contexts = entries >> np.uint64(64 - 8 * d) if d else np.zeros(len(entries), np.uint64)
        #: Entries, at the beginning and the end, of contexts that go on outside.
        self.ends = [(prefix(low, d), 0, int(np.searchsorted(contexts, np.uint64(prefix(low, d)), "right"))),
                     (prefix(high, d), int(np.searchsorted(contexts, np.uint64(prefix(high, d)))), len(entries))]
        if self.ends[0][0] == self.ends[1][0]:
            del self.ends[1]

    def nodes(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes after ``bit`` bits of the byte: first entry of each, and
        how often 0 and 1 came."""
        first = np.flatnonzero(self.shared < 8 * self.d + bit)
        total = self.sums[np.append(first[1:], len(self.entries))] - self.sums[first]
        ones = np.add.reduceat(self.counts * (self.byte >> (7 - bit) & 1), first)
        return first, total - ones, ones

    def outside(self, first: np.ndarray):
        """(context, slice of the nodes) of the contexts that go on outside."""
        for context, a, b in self.ends:
            if a < b:
                yield context, slice(*np.searchsorted(first, (a, b)))

    def heap(self, first: np.ndarray, bit: int) -> np.ndarray:
        """Numbers of the nodes within their contexts, as in a heap from 1."""
        return (1 << bit) + (self.byte[first].astype(np.int64) >> (8 - bit))


class Range:
    """Grams from ``low`` up to ``high``, in order, with training counts."""

    def __init__(self, found: np.ndarray, counts: np.ndarray, low: int, high: int):
        self.levels, self.up = [Level(DEPTH, found, counts, low, high)], []
        for d in range(DEPTH - 1, -1, -1):  # (context, byte) of each depth, and where the deeper ones belong
            e = self.levels[0].entries
            byte = (e >> np.uint64(48 - 8 * d)) & np.uint64(255)
            shorter = (e >> np.uint64(64 - 8 * d) << np.uint64(64 - 8 * d) if d else np.uint64(0)) | (
                byte << np.uint64(56 - 8 * d))
            own, up = np.unique(shorter, return_inverse=True)
            n = np.bincount(up, self.levels[0].counts, len(own)).astype(np.int64)
            self.levels.insert(0, Level(d, own, n, low, high))
            self.up.insert(0, up.astype(np.int32))

    def bottom_up(self, bit: int) -> list[dict]:
        """Per depth the nodes after ``bit`` bits of the byte: first entry,
        counts, sums of what is below (without contexts that go on outside) and
        the share of the own estimate; ``node`` is each entry's node."""
        out: list[dict] = [{} for _ in range(DEPTH + 1)]
        for d in range(DEPTH, -1, -1):
            level = self.levels[d]
            first, zeros, ones = level.nodes(bit)
            alone = log_kt(zeros, ones)
            found = {"first": first, "zeros": zeros, "ones": ones}
            if d == DEPTH:
                found |= {"below": np.zeros(len(first)), "weighted": alone, "share": np.ones(len(first))}
            else:
                node = np.cumsum(level.shared < 8 * d + bit, dtype=np.int32) - np.int32(1)
                deep = out[d + 1]
                whole = deep["weighted"].copy()
                for _, some in self.levels[d + 1].outside(deep["first"]):
                    whole[some] = 0
                deep["parent"] = node[self.up[d][deep["first"]]]
                below = np.bincount(deep["parent"], whole, len(first))
                weighted, share = mixed(alone, below)
                found |= {"below": below, "weighted": weighted, "share": share}
            out[d] = found
        return out

    def parts(self) -> list[tuple[np.ndarray, ...]]:
        """What the range adds to contexts that go on outside: arrays of depth,
        context, heap, zeros, ones and below."""
        rows = []
        if len(self.levels[0].entries):
            for bit in range(8):
                for level, nodes in zip(self.levels, self.bottom_up(bit)):
                    for context, some in level.outside(nodes["first"]):
                        heap = level.heap(nodes["first"][some], bit)
                        rows.append((np.full(len(heap), level.d), np.full(len(heap), context), heap,
                                     nodes["zeros"][some], nodes["ones"][some], nodes["below"][some]))
        return rows

    def code_lengths(self, given: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """log10 probability of each gram's byte, mixed over all depths.
        ``given``: share and estimate per heap number of the contexts that go on
        outside."""
        grams = self.levels[DEPTH]
        p = np.ones(len(grams.entries))
        if not len(p):
            return p
        for bit in range(8):
            out, left = np.zeros(1), np.ones(1)
            for level, nodes in zip(self.levels, self.bottom_up(bit)):
                first, share = nodes["first"], nodes["share"]
                estimate = (nodes["ones"] + .5) / (nodes["zeros"] + nodes["ones"] + 1)
                for context, some in level.outside(first):
                    own = given[level.d, context][:, level.heap(first[some], bit)]
                    share[some], estimate[some] = own
                if level.d:
                    out, left = out[nodes["parent"]], left[nodes["parent"]]
                elif len(first) > 1:
                    out, left = np.zeros(len(first)), np.ones(len(first))
                out, left = out + left * share * estimate, left * (1 - share)
            node = np.cumsum(grams.shared < 8 * DEPTH + bit, dtype=np.int32) - np.int32(1)
            one = out[node]
            p *= np.where(grams.byte >> (7 - bit) & 1, one, 1 - one)
        return np.log10(p)


def bounds(cuts: np.ndarray, number: int) -> tuple[int, int]:
    """First gram of a range and of the next one (the last: the last gram)."""
    return (int(cuts[number - 1]) if number else 0,
            int(cuts[number]) if number < len(cuts) else (1 << 64) - 1)


def chosen_cuts(sample: np.ndarray, asked: float, range_grams: int, least: int) -> np.ndarray:
    ranges = max(least, math.ceil(asked / range_grams))
    sample = np.sort(sample)
    return np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) else sample


def put_together(parts: DataFrame) -> DataFrame:
    """(depth, context, heap, share, estimate) of the contexts that cuts run
    through, from what the ranges add to them: one aggregation per depth, from
    the deepest up, each passing its weights on to the next."""
    def work(batches):
        for batch in batches:
            zeros, ones, below = (batch.column(c).to_numpy() for c in ("zeros", "ones", "below"))
            alone = log_kt(zeros, ones)
            deepest = batch.column("deepest").to_numpy(zero_copy_only=False)
            weighted, share = mixed(alone, below)
            yield {"context": batch.column("context"), "heap": batch.column("heap"),
                   "share": np.where(deepest, 1, share), "estimate": (ones + .5) / (zeros + ones + 1),
                   "weighted": np.where(deepest, alone, weighted)}

    levels, above = [], None
    for d in range(DEPTH, -1, -1):
        own = parts.where(F.col("depth") == d).select("context", "heap", "zeros", "ones", "below")
        if above is not None:
            own = own.unionByName(above.select(F.shiftright("context", 8).alias("context"), "heap",
                                               F.lit(0).cast("long").alias("zeros"), F.lit(0).cast("long").alias("ones"),
                                               F.col("weighted").alias("below")))
        added = own.groupBy("context", "heap").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
        above = stored(map_batches(added.withColumn("deepest", F.lit(d == DEPTH)), work,
                                   "context long, heap long, share double, estimate double, weighted double"), "nodes")
        levels.append(above.select(F.lit(d).alias("depth"), "context", "heap", "share", "estimate"))
    return functools.reduce(DataFrame.unionByName, levels)


def scores(heads: DataFrame, trained_of, least_ranges: int, range_grams: int = RANGE_GRAMS,
           sampled: int = SAMPLED) -> DataFrame:
    """(scored, measures): the log10 probabilities of the texts of each block of
    ``heads`` (block, doc_ids, sizes, packed). ``trained_of(ids)`` says which
    texts are counted. Blocks without a byte have a measure of 0 per text."""
    spark = heads.sparkSession
    ship(spark)

    def own(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return unpack(row["packed"]), np.array(row["sizes"], np.int64), trained_of(row["doc_ids"])

    def steps(data: np.ndarray, sizes: np.ndarray, start: int, stop: int):
        """Of each step of a block's bytes from start to stop: grams and the
        numbers of the texts that they are in."""
        ends = np.cumsum(sizes)
        for a in range(start, stop, STEP):
            b = min(stop, a + STEP)
            yield grams(data, ends - sizes, a, b), texts_of(ends, a, b)

    def runs(data: np.ndarray, sizes: np.ndarray, trained: np.ndarray):
        """Grams of each run of a block's bytes: those that are counted and,
        behind them in the same array, the others; and how many are counted."""
        for start in range(0, max(1, len(data)), RUN):
            stop = min(len(data), start + RUN)
            run, front, back = np.empty(stop - start, np.uint64), 0, stop - start
            for g, text in steps(data, sizes, start, stop):
                used = trained[text]
                counted, others = g[used], g[~used]
                run[front:front + len(counted)] = counted
                run[back - len(others):back] = others
                front, back = front + len(counted), back - len(others)
            yield run, front

    def blocks(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield batch.slice(at, 1).to_pylist()[0]

    def chosen(batches):
        for row in blocks(batches):
            data, sizes, _ = own(row)
            for g, _ in steps(data, sizes, 0, len(data)):
                some = g[g * np.uint64(0x9E3779B97F4A7C15) < np.uint64(((1 << 64) - 1) // sampled)]
                yield {"gram": np.unique(some).view(np.int64)}

    sample = stored(map_batches(heads, chosen, "gram long"), "sample")
    grams_of = sample.toArrow().column("gram").to_numpy().view(np.uint64)
    cuts = chosen_cuts(grams_of, float(len(grams_of)) * sampled, range_grams, least_ranges)

    def asked(batches):
        for row in blocks(batches):
            every = Merging()
            for run, front in runs(*own(row)):
                every.add(*distinct(run[:front], run[front:]))
                del run
            g, n = every.all()
            ends = np.r_[0, np.searchsorted(g, cuts), len(g)]
            which = np.flatnonzero(np.diff(ends))
            for start in range(0, len(which), 64):
                some = which[start:start + 64]
                yield {"block": [row["block"]] * len(some), "range": some,
                       "grams": [squeeze_grams(g[ends[r]:ends[r + 1]]) for r in some],
                       "counts": [squeeze(n[ends[r]:ends[r + 1]]) for r in some]}

    requests = map_batches(heads, asked, "block long, range int, grams binary, counts binary")

    part_ddl = "depth int, context long, heap long, zeros long, ones long, below double"
    range_ddl = "grams binary, counts binary, blocks array<long>, places array<binary>"
    part_arrow, range_arrow = (to_arrow_schema(T.StructType.fromDDL(f"range int, {ddl}"))
                               for ddl in (part_ddl, range_ddl))
    both_shape = T.StructType.fromDDL(f"range int, {part_ddl}, {range_ddl}")
    both_arrow = to_arrow_schema(both_shape)

    def upward(rows: pa.Table) -> pa.Table:
        """One row of the range itself and the rows of what it adds outside."""
        number = rows.column("range")[0].as_py()
        found = [unsqueeze_grams(g) for g in rows.column("grams").to_pylist()]
        g, n = merged(found, [unsqueeze(n).astype(np.int64) for n in rows.column("counts").to_pylist()])
        places = [squeeze(np.diff(np.searchsorted(g, some), prepend=0)) for some in found]
        whole = pa.table([[number], [squeeze_grams(g)], [squeeze_counts(n)], [rows.column("block").to_pylist()],
                          [places]], schema=range_arrow)
        del found
        parts = Range(g, n, *bounds(cuts, number)).parts()
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 6
        outside = pa.table([pa.array(np.full(len(columns[0]), number), pa.int32()),
                            *(pa.array(c.astype(f.type.to_pandas_dtype()), f.type)
                              for c, f in zip(columns, list(part_arrow)[1:]))], schema=part_arrow)
        return pa.concat_tables([both_arrow.empty_table(), whole, outside], promote_options="default")

    ranges = stored(requests.groupBy("range").applyInArrow(upward, both_shape), "ranges")
    parts = ranges.where("depth IS NOT NULL")
    nodes, keys = put_together(parts), ["depth", "context", "heap"]
    release(sample)  # and the requests' shuffle, whose job ended a while ago
    wanted = parts.select("range", *keys)
    # Contexts of at most one byte are in many ranges; they have at most 257 * 255 nodes.
    given = (wanted.where("depth <= 1").join(F.broadcast(nodes.where("depth <= 1")), keys)
             .unionByName(wanted.where("depth > 1").join(nodes.where("depth > 1"), keys)))

    answer_shape = T.StructType.fromDDL("block long, range int, lengths binary")
    answer_arrow = to_arrow_schema(answer_shape)

    def downward(rows: pa.Table, shared: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return answer_arrow.empty_table()
        row = rows.to_pylist()[0]  # one row per range
        known: dict[tuple[int, int], np.ndarray] = {}
        depth, context, heap, share, estimate = (shared.column(c).to_numpy()
                                                 for c in (*keys, "share", "estimate"))
        for name in set(zip(depth.tolist(), context.tolist())):
            some = (depth == name[0]) & (context == name[1])
            known[name] = np.zeros((2, 256))
            known[name][:, heap[some]] = share[some], estimate[some]
        piece = Range(unsqueeze_grams(row["grams"]), unsqueeze_counts(row["counts"]), *bounds(cuts, row["number"]))
        values = piece.code_lengths(known).astype(np.float32).view(np.uint32)
        lengths = [squeeze(values[np.cumsum(unsqueeze(p), dtype=np.int64)]) for p in row["places"]]
        return pa.table([pa.array(row["blocks"], pa.int64()), pa.array([row["number"]] * len(lengths), pa.int32()),
                         pa.array(lengths, pa.binary())], schema=answer_arrow)

    answers = (ranges.where("grams IS NOT NULL").select(F.col("range").alias("number"), "grams", "counts", "blocks", "places")
               .groupBy("number").cogroup(given.groupBy("range")).applyInArrow(downward, answer_shape))
    shape = T.StructType.fromDDL("scored long, measures array<double>")
    arrow = to_arrow_schema(shape)

    def summed(rows: pa.Table, found: pa.Table) -> pa.Table:
        blocks, sums = [], []
        for row in rows.to_pylist():  # one row per block
            data, sizes, trained = own(row)
            out, merging = np.zeros(len(sizes)), Merging(united)
            for run, _ in runs(data, sizes, trained):
                run.sort()
                merging.add(run[firsts(run)])
                del run
            every, = merging.all()
            lengths = np.concatenate([np.zeros(0, np.float32), *(
                unsqueeze(x).astype(np.uint32).view(np.float32)
                for x in found.sort_by("range").column("lengths").to_pylist())])
            for g, text in steps(data, sizes, 0, len(data)):
                order = np.argsort(g)  # looked up in order, each once, the table is read once
                g = g[order]
                first, own_lengths = firsts(g), np.empty(len(g), np.float32)
                own_lengths[order] = np.repeat(lengths[np.searchsorted(every, g[first])],
                                               np.diff(np.append(first, len(g))))
                out += np.bincount(text, own_lengths, len(sizes))
            blocks.append(row["block"])
            sums.append(out.tolist())
        return pa.table([pa.array(blocks, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], schema=arrow)

    out = stored(heads.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, shape), "scores")
    release(ranges)
    return out
