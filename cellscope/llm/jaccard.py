"""Word-n-gram Jaccard join by a size-aware heavy-light method.

Documents are sets of shingles (64-bit hashes). Two sets that are alike enough
share many shingles, so they share some among the rarest of each:

* A *light* (small) set emits every subset of ``SUBSET`` of its rarest
  shingles; light sets that are alike have one of these keys in common.
* A *heavy* (large) set would have too many subsets. It stands in the inverted
  lists of its rarest shingles, which are scanned; light sets near the boundary
  stand there too, as partners of heavy ones.

The size at which sets become heavy is chosen by cost, from the number of keys
that sets of each size would emit and the lengths of the lists they would scan.

Only components are wanted, so lists are not expanded into pairs. Lists with the
same pivot, the member of least hash, become one. Members are verified against a
pivot; a list whose members are then in one component is done. The others are
dealt into blocks of bounded size, each guest (a member outside the list's
largest component) against all members. Parity bitmaps, whose differing bits
bound the differing shingles from below, say which pairs may be alike; a spanning
forest of these is verified. Where a pair of it fails, the sets concerned are
verified in full, by scanning the inverted lists of their block.

Before that, sets leave that cannot have a partner: those of whose shingles too
few occur in any other set. Shingles are counted in hash ranges; a block of
texts sends its distinct shingles there and gets their counts back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_type, map_batches, partition_number, release, ship, slices, stored, sweep, two_columns
from .components import components
from .simhash import Forest

#: Text and rows of a block; text whose shingles one hash range holds, about.
BLOCK_BYTES, BLOCK_ROWS, RANGE_BYTES = 8 << 20, 20_000, 24 << 20
#: Shingles of a light set's key, and what emitting a key costs in entries of
#: a scanned list.
SUBSET, KEY_COST = 2, 8
#: Members and guests of a verified block.
MEMBERS = 512
#: Bits of the parity bitmap of a set of up to half as many shingles; larger
#: sets have twice, four times, ... as many.
BITMAP = 2048
#: Words of which a worker remembers the hash.
WORDS = 1 << 18

B = [np.uint64(pow(0x9E3779B97F4A7C15, i, 2**64)) for i in range(64)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The set of a lower-cased text: distinct hashes of its word n-grams, in
    order. With fewer words the whole sequence is one; without words: empty."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = h[:n].copy()
    for i in range(1, size):
        total += h[i:i + n] * B[i]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(29)))


def short(h: np.ndarray) -> np.ndarray:
    """48 bits of the hashes, by which shingles are counted. A collision makes a
    count too high, which costs time and no result."""
    return h >> np.uint64(16)


def squeeze(sorted_numbers: np.ndarray) -> bytes:
    planes = np.diff(sorted_numbers, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def least_overlap(n, percent: int):
    """Shingles that a set of n shares with any set that is alike, at least."""
    return (percent * n + 99) // 100


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def blocks(df: DataFrame, size: int, ranges: int, id_col: str, text_col: str) -> DataFrame:
    """The stored block table. A head (range null) has the documents (doc_ids,
    sizes of sets, their 128-bit keys) and the texts of its distinct sets; the
    other rows have the distinct shingles of one hash range and their counts."""
    kind = id_type(df, id_col)

    def work(batches):
        part, seq, held, size_held = partition_number(), 0, [], 0
        hashes = WordHashes()

        def block_rows():
            ids, texts = [], []
            for batch in held:
                ids += batch.column("doc_id").to_pylist()
                texts += batch.column("text").to_pylist()
            sizes, k1, k2, kept, sets, seen = [], [], [], [], [], set()
            for text in texts:
                raw = text.encode().lower()
                own = shingles(raw, size, hashes)
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                sizes.append(len(own))
                k1.append(signed(digest >> 64) if len(own) else None)
                k2.append(signed(digest & (1 << 64) - 1) if len(own) else None)
                if len(own) and digest not in seen:
                    seen.add(digest)
                    kept.append(raw)
                    sets.append(short(own))
            number = part << 32 | seq
            none = dict.fromkeys(("doc_ids", "sizes", "k1", "k2", "lengths", "packed", "shingles", "counts"))
            yield none | {"block": number, "range": None, "doc_ids": ids, "sizes": sizes, "k1": k1, "k2": k2,
                          "lengths": [len(r) for r in kept],
                          "packed": zstandard.ZstdCompressor(level=1).compress(b"".join(kept))}
            found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            which = range_of(found, ranges)
            edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(found) else np.zeros(1, int)
            for a, b in zip(edges, edges[1:]):
                yield none | {"block": number, "range": int(which[a]), "shingles": squeeze(found[a:b]),
                              "counts": zstandard.ZstdCompressor(level=1).compress(
                                  np.minimum(counts[a:b], 255).astype(np.uint8).tobytes())}

        def closed():
            rows = list(block_rows())
            for start in range(0, len(rows), 256):
                yield {c: [r[c] for r in rows[start:start + 256]] for c in rows[0]}

        for batch in slices(batches):
            more = batch.column("text").nbytes
            if held and (size_held + more > BLOCK_BYTES or sum(b.num_rows for b in held) >= BLOCK_ROWS):
                yield from closed()
                held, size_held, seq = [], 0, seq + 1
            held.append(batch)
            size_held += more
        if held:
            yield from closed()

    return stored(map_batches(two_columns(df, id_col, text_col), work,
                              f"block long, range long, doc_ids array<{kind}>, sizes array<long>, k1 array<long>, "
                              "k2 array<long>, lengths array<long>, packed binary, shingles binary, counts binary"),
                  "shingles")


def range_of(numbers: np.ndarray, ranges: int) -> np.ndarray:
    """The equal part of the 48-bit numbers that each lies in."""
    return ((numbers >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def counted(table: DataFrame) -> DataFrame:
    """(block, range, df): in how many sets each shingle of a row occurs, up to
    255."""
    shape = T.StructType.fromDDL("block long, range long, df binary")
    arrow = to_arrow_schema(shape)

    def work(rows: pa.Table) -> pa.Table:
        found = [unsqueeze(s) for s in rows.column("shingles").to_pylist()]
        counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint8)
                  for c in rows.column("counts").to_pylist()]
        every = np.concatenate(found)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        total = np.minimum(np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first), 255)
        back = np.empty(len(every), np.uint8)
        back[order] = np.repeat(total, np.diff(np.append(first, len(every))))
        ends = np.cumsum([len(f) for f in found])
        press = zstandard.ZstdCompressor(level=1).compress
        return pa.table([rows.column("block"), rows.column("range"),
                         pa.array([press(back[e - len(f):e].tobytes()) for f, e in zip(found, ends)], pa.binary())],
                        schema=arrow)

    return (table.where("range IS NOT NULL").select("block", "range", "shingles", "counts")
            .groupBy("range").applyInArrow(work, shape))


def candidates(table: DataFrame, size: int, percent: int) -> DataFrame:
    """(k1, k2, n, tokens, df, bits): the distinct sets that may have a partner, their
    shingles from rare to common (ties by hash), the counts of these, and the
    bitmap."""
    ship(table.sparkSession)
    shape = T.StructType.fromDDL("k1 long, k2 long, n long, tokens binary, df binary, bits binary")
    arrow = to_arrow_schema(shape)

    def work(heads: pa.Table, answers: pa.Table) -> pa.Table:
        out = {c: [] for c in arrow.names}
        hashes = WordHashes()
        df = np.concatenate([np.zeros(0, np.uint8), *(
            np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
            for x in answers.sort_by("range").column("df").to_pylist())])
        for head in heads.to_pylist():  # one row per block
            data = zstandard.ZstdDecompressor().decompress(head["packed"])
            ends = np.cumsum(head["lengths"]).tolist()
            sets = [shingles(data[e - n:e], size, hashes) for n, e in zip(head["lengths"], ends)]
            every = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(short, sets)]))
            shared = np.append(every[df > 1], ~np.uint64(0))  # few against all, so looked up in cache
            times = np.append(df[df > 1], np.uint8(1))
            for own in sets:
                at = np.searchsorted(shared, short(own))
                found = shared[at] == short(own)
                if found.sum() < least_overlap(len(own), percent):
                    continue
                counts = np.where(found, times[at], np.uint8(1))
                order = np.lexsort((own, counts))
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                for c, v in zip(out, (signed(digest >> 64), signed(digest & (1 << 64) - 1), len(own),
                                      own[order].tobytes(), counts[order].tobytes(), bitmap(own))):
                    out[c].append(v)
        return pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    answers = stored(counted(table), "shingle-counts")
    sweep(table.sparkSession)  # the shuffled shingles are the most that lies on disk
    heads = table.where("range IS NULL").select("block", "lengths", "packed")
    found = heads.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, shape)
    distinct = found.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"),
                                             F.first("df").alias("df"), F.first("bits").alias("bits"))
    return stored(distinct.withColumn("node", F.monotonically_increasing_id()), "sets")


def bitmap(own: np.ndarray) -> bytes:
    """A bit is 1 if an odd number of the set's shingles fall on it. The sets of
    two bitmaps differ in at least as many shingles as the bitmaps in bits."""
    size = max(BITMAP, 1 << (2 * len(own) - 1).bit_length())
    counts = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes of the same set."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


class Bitmaps:
    """Bitmaps of several sizes, compared at the smaller size of a pair."""

    def __init__(self, bits: list[bytes]):
        own = np.array([len(b) for b in bits])
        self.own, self.tables = own, {}
        for size in np.unique(own).tolist():
            at = np.flatnonzero(own >= size)
            self.tables[size] = at, np.stack([folded(bits[i], size) for i in at])

    def apart(self, one: int) -> np.ndarray:
        """In how many bits each bitmap differs from this one."""
        out = np.zeros(len(self.own), np.int64)
        for size, (at, table) in self.tables.items():
            if size > self.own[one]:
                break
            differing = np.bitwise_count(table ^ table[np.searchsorted(at, one)]).sum(axis=1, dtype=np.int64)
            chosen = self.own[at] == size if size < self.own[one] else slice(None)
            out[at[chosen]] = differing[chosen]
        return out


def rare(n: int, df: np.ndarray, percent: int, together: int) -> slice:
    """Where in a set's order the shingles lie of which any two sets that are
    alike share ``together``; those that no other set has are left out."""
    return slice(int(np.searchsorted(df, 2)), max(0, n - least_overlap(n, percent) + together))


def chosen_boundary(sets: DataFrame, percent: int) -> int:
    """The largest size of light sets, by cost. Sizes are taken together in
    sixteenths of a power of two, so few rows reach the driver."""
    def work(batches):
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            light, heavy = [], []
            for n, raw in zip(sizes.tolist(), batch.column("df").to_pylist()):
                df = np.frombuffer(raw, np.uint8)
                m = len(df[rare(n, df, percent, SUBSET)])
                light.append(KEY_COST * m * (m - 1) / 2)
                heavy.append(float(df[rare(n, df, percent, 1)].sum(dtype=np.int64)))
            yield {"class": np.ceil(np.log2(sizes) * 16).astype(np.int64), "light": light, "heavy": heavy}

    costs = (map_batches(sets.select("n", "df"), work, "class long, light double, heavy double").groupBy("class")
             .agg(F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).orderBy("class").collect())
    best, boundary, total = sum(r.heavy for r in costs), 0, sum(r.heavy for r in costs)
    for row in costs:
        total += row.light - row.heavy
        if total < best:
            best, boundary = total, int(2 ** (row["class"] / 16))
    return boundary


def listed(sets: DataFrame, percent: int, boundary: int) -> DataFrame:
    """(key, node, n): subsets of light sets, and the inverted lists that heavy
    sets are found in."""
    partner = least_overlap(boundary + 1, percent)  # light sets from this size on may be alike heavy ones

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                keys, nodes, sizes = [], [], []
                for node, n, tokens, raw in zip(*(some.column(c).to_pylist() for c in ("node", "n", "tokens", "df"))):
                    own, df = np.frombuffer(tokens, np.uint64), np.frombuffer(raw, np.uint8)
                    found = []
                    if n <= boundary:
                        rarest = own[rare(n, df, percent, SUBSET)]
                        a, b = np.triu_indices(len(rarest), 1)
                        low, high = np.minimum(rarest[a], rarest[b]), np.maximum(rarest[a], rarest[b])
                        found.append(low * B[1] ^ (high + B[2]) * B[3])
                    if n >= partner:
                        found.append(own[rare(n, df, percent, 1)])
                    found = np.concatenate([np.zeros(0, np.uint64), *found])
                    keys.append(found)
                    nodes.append(np.full(len(found), node))
                    sizes.append(np.full(len(found), n))
                if nodes:
                    yield {"key": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes),
                           "n": np.concatenate(sizes)}

    keys = stored(map_batches(sets, work, "key long, node long, n long"), "keys")
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    out = stored(keys.join(shared, "key"), "shared-keys")
    release(keys)
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def by_pivot(lists: DataFrame) -> DataFrame:
    """The lists, those with the same pivot (member of least hash) as one, whose
    key it is. All members are still together with all that they were with."""
    pivots = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(1), "node").alias("h"), "node")).alias("pivot"))
    return stored(lists.join(pivots, "key").select(F.col("pivot.node").alias("key"), "node", "n").distinct(), "lists")


def pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member with one pivot, that of its largest list."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("members"),
                                     F.max(F.when(F.col("key") == F.col("node"), F.col("n"))).alias("m"))
    sized = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return (lists.join(sizes, "key").where(sized & (F.col("node") != F.col("key")))
            .groupBy("node").agg(F.max(F.struct("members", "key")).alias("largest"))
            .select(F.col("node").alias("a"), F.col("largest.key").alias("b")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b"))

    def work(batches):
        for batch in batches:
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(
                batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            mask = pa.array(good, pa.bool_())
            yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

    return stored(map_batches(both.select("a", "b", "x", "y"), work, "a long, b long"), "links")


def open_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, n, component) of the lists with more than one component."""
    known = (lists.select("key", "node", "n").join(found, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    state = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return stored(known.join(state.where("low <> high").select("key"), "key"), "open-lists")


def dealt(lists: DataFrame) -> DataFrame:
    """(key, block, part, node, component, guest): each list in blocks of its
    members; each block meets all guests of the list, in parts."""
    sized = lists.groupBy("key", "component").count()
    largest = (sized.groupBy("key").agg(F.max(F.struct("count", "component")).alias("top"),
                                        F.sum("count").alias("members"))
               .select("key", F.col("top.component").alias("largest"),
                       F.ceil(F.col("members") / MEMBERS).cast("long").alias("blocks"),
                       F.ceil((F.col("members") - F.col("top.count")) / MEMBERS).cast("long").alias("parts")))
    rows = lists.join(largest, "key").withColumn("deal", F.xxhash64(F.lit(3), "node"))
    members = rows.select("key", "node", "component", F.lit(False).alias("guest"),
                          F.pmod("deal", "blocks").alias("block"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    guests = (rows.where("component <> largest")
              .select("key", "node", "component", F.lit(True).alias("guest"), F.pmod("deal", "parts").alias("part"),
                      F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")))
    return members.unionByName(guests).groupBy("key", "block", "part", "node", "component").agg(
        F.max("guest").alias("guest"))


def maybe_alike(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, a, b): members of a list that may be alike by their bitmaps, as a
    spanning forest over the list's components: whatever pairs of its blocks may
    be alike, these connect the same components."""
    ship(lists.sparkSession)
    shape = T.StructType.fromDDL("key long, a long, b long")
    arrow = to_arrow_schema(shape)

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes, sizes = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        _, component = np.unique(rows.column("component").to_numpy(), return_inverse=True)
        bitmaps = Bitmaps(rows.column("bits").to_pylist())
        forest = Forest(component.max() + 1)
        a, b = [], []
        for guest in np.flatnonzero(rows.column("guest").to_numpy(zero_copy_only=False)).tolist():
            both, apart = sizes + sizes[guest], bitmaps.apart(guest)
            near = np.flatnonzero(100 * (both - apart) >= percent * (both + apart))
            roots = forest.roots(component[near])
            others, first = np.unique(roots, return_index=True)
            for other in first[others != forest.roots(component[[guest]])[0]].tolist():
                forest.join(component[[guest]], component[near[[other]]])
                a.append(nodes[guest])
                b.append(nodes[near[other]])
        return pa.table([pa.array(np.full(len(a), rows.column("key")[0].as_py()), pa.int64()),
                         pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    groups = dealt(lists).join(sets.select("node", "n", "bits"), "node")
    return stored(groups.select("key", "block", "part", "node", "component", "guest", "n", "bits")
                  .groupBy("key", "block", "part").applyInArrow(work, shape), "maybe-alike")


def rest_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the components of each open list as far as
    its sets are alike."""
    ship(lists.sparkSession)
    groups = dealt(lists).join(sets.select("node", "tokens"), "node")
    shape = T.StructType.fromDDL("a long, b long")
    arrow = to_arrow_schema(shape)

    def work(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        _, component = np.unique(rows.column("component").to_numpy(), return_inverse=True)
        own = [np.frombuffer(t, np.uint64) for t in rows.column("tokens").to_pylist()]
        sizes = np.array([len(t) for t in own])
        token, at = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(token, kind="stable")
        token, at = token[order], at[order]
        forest = Forest(component.max() + 1)
        a, b = [], []
        for guest in np.flatnonzero(rows.column("guest").to_numpy(zero_copy_only=False)):
            low, high = (np.searchsorted(token, own[guest], side) for side in ("left", "right"))
            spans = high - low
            every = np.repeat(high - np.cumsum(spans), spans) + np.arange(spans.sum())
            both = np.bincount(at[every], minlength=len(own))
            near = np.flatnonzero(100 * both >= percent * (sizes + sizes[guest] - both))
            for other in near:
                mine = forest.roots(component[[guest, other]])
                if mine[0] != mine[1]:
                    forest.join(component[[guest]], component[[other]])
                    a.append(nodes[guest])
                    b.append(nodes[other])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    found = (groups.select("key", "block", "part", "node", "component", "guest", "tokens")
             .groupBy("key", "block", "part").applyInArrow(work, shape))
    return stored(found, "links")


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that are linked to another one, but for
    the set that names a component."""
    every = listed(sets, percent, chosen_boundary(sets, percent))
    lists = by_pivot(every)
    edges = verified(pivot_pairs(lists, percent), sets, percent)
    still = open_lists(lists, components(edges))
    pairs = maybe_alike(still, sets, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = edges.unionByName(verified(pairs.distinct(), sets, percent))
    # Lists in which a pair failed: others may connect the same components.
    found = components(edges)
    still = open_lists(still, found)
    failed = maybe_alike(still, sets, percent).select("key").distinct()
    edges = edges.unionByName(rest_links(still.join(failed, "key"), sets, percent))
    release(every, lists)
    return components(edges)


def jaccard_components(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents are linked when ``100 * shared >= percent * all`` of their
    distinct shingles of ``size`` words (fewer words: the whole sequence is
    one). ``component_id`` is the least doc_id reachable over links, the own
    one included. Documents without words or text are linked with nothing.
    Equal sets are one node, so copies are never paired. Repeated rows give a
    row each; rows with a null id are linked, but name a component only if it
    has no other id (null). An empty table gives no rows. Other columns are not
    read. Shingles are 64-bit hashes, sets 128-bit ones.
    """
    text = F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))
    total = df.agg(text.alias("b")).first().b
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    table = blocks(df, size, ranges, id_col, text_col)
    sets = candidates(table, size, percent)
    rows = stored(table.where("range IS NULL").select(F.inline(F.arrays_zip("doc_ids", "sizes", "k1", "k2")))
                  .withColumnsRenamed({"doc_ids": "doc_id", "sizes": "n_shingles"}), "rows")
    release(table)
    found = linked_sets(sets, percent)
    least = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    node = sets.select("k1", "k2", "node").join(found, "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("component"))
    least = stored(least.join(node, ["k1", "k2"], "left"), "least")
    names = (least.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("name")))
    named = least.join(names, "component", "left").select("k1", "k2", F.coalesce("name", "least").alias("name"))
    return (rows.join(named, ["k1", "k2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id")))
