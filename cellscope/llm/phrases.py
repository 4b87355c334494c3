"""Phrase collocations by HAT-trie counting.

A task counts phrases in a trie over local word numbers. Hash containers hang
under ranges of first words (in the second pass: of first word pairs, two levels
at once); one that grows beyond ``BURST`` entries bursts into two at its median.
When the trie holds ``HELD`` entries, whole subtrees, largest first, are spilled as
sorted runs of (phrase, count). Spark's exchange merges the runs of all tasks;
it deals them out by the whole phrase, because a partition per first word would
be as large as the commonest word makes it.

Phrases are counted in two passes. The first counts words and pairs. A longer
phrase can be frequent only if its pairs are, so the second pass counts the
phrases of which all pairs are in a filter of the frequent pairs. The filter
(Bloom) has a fixed size and no false negatives: whatever its load, nothing
frequent is missed.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, release, slices, stored
from .terms import Terms

#: What ends a piece of text; no word holds one of these bytes, so all become
#: ``MARK``, a word of its own.
MARK = b"."
ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", MARK * 10)
#: Entries of a container that bursts, of a trie, and words of a task's table.
BURST, HELD, WORDS = 1 << 14, 600_000, 200_000
#: Bytes of text counted at once; rows of a spilled batch.
STEP, SPILL_ROWS = 1 << 20, 50_000
#: The filter of frequent pairs: bits (as a power of two) and probes.
FILTER_BITS, PROBES = 26, 3
#: Rows of one language and task in the last rounds of the ranking: fan-in.
FAN_IN = 32

#: A phrase is one number: its prefix (number of the first word or pair) in the
#: upper half; in the lower one 0, the number of the next word, or ``PAIR`` and
#: the number of the next pair.
HALF, PAIR = 32, 1 << 31
LOW = (1 << HALF) - 1


class Containers:
    """The trie: hash containers (phrase -> count), each under a range of
    prefixes that begins where ``starts`` says."""

    def __init__(self, burst: int):
        self.burst, self.starts, self.tables, self.entries = burst, [0], [{}], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counts phrases, in order."""
        edges = np.searchsorted(keys, np.array(self.starts[1:], np.int64) << HALF)
        edges = [0, *edges.tolist(), len(keys)]
        keys, counts, full = keys.tolist(), counts.tolist(), []
        for number, own in enumerate(self.tables):
            get, before = own.get, len(own)
            for k, c in zip(keys[edges[number]:edges[number + 1]], counts[edges[number]:edges[number + 1]]):
                own[k] = get(k, 0) + c
            self.entries += len(own) - before
            if len(own) > self.burst:
                full.append(self.starts[number])
        for start in full:
            self.burst_at(start)

    def burst_at(self, start: int) -> None:
        """Containers of at most ``burst`` entries, or of one prefix, in place
        of one."""
        number = bisect.bisect_left(self.starts, start)
        own = self.tables[number]
        ordered = sorted(own)
        middle = ordered[len(ordered) // 2] >> HALF
        if middle == ordered[0] >> HALF:  # the lower half is one prefix
            middle += 1
        cut = bisect.bisect_left(ordered, middle << HALF)
        if len(own) <= self.burst or cut == len(ordered):
            return
        self.starts.insert(number + 1, middle)
        self.tables[number:number + 1] = [{k: own[k] for k in ordered[:cut]}, {k: own[k] for k in ordered[cut:]}]
        self.burst_at(middle)
        self.burst_at(start)

    def spilled(self, keep: int):
        """Sorted runs (phrases, counts) of whole containers, largest first,
        until at most ``keep`` entries are left."""
        for number in sorted(range(len(self.tables)), key=lambda i: -len(self.tables[i])):
            own = self.tables[number]
            if self.entries <= keep or not own:
                return
            keys = np.fromiter(own, np.int64, len(own))
            counts = np.fromiter(own.values(), np.int64, len(own))
            self.entries -= len(own)
            self.tables[number] = {}
            order = np.argsort(keys)
            yield keys[order], counts[order]


class Trie:
    """The phrases of one language in one task: the numbers of words and pairs,
    and the containers."""

    def __init__(self, burst: int):
        self.total, self.containers = 0, Containers(burst)
        self.forget()

    def forget(self) -> None:
        """New tables of words and pairs, once everything is spilled."""
        self.words, self.pairs = Terms({MARK: 0}), Terms()
        self.hashes = np.zeros(1, np.uint64)
        self.tables = pa.array([], pa.binary()), np.zeros(0, np.int64)

    def numbers(self, raws: list[bytes]) -> np.ndarray:
        """Word numbers, 0 between pieces and texts."""
        tokens = b"\n".join(raws).lower().translate(ENDS).replace(MARK, b" . ").split()
        return np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))

    def word_hashes(self) -> np.ndarray:
        known = len(self.hashes)
        if known < len(self.words):
            new = list(self.words)[known:]
            self.hashes = np.concatenate([self.hashes, np.fromiter(
                map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return self.hashes

    def spelled(self, keys: np.ndarray, of_pairs: bool) -> pa.Array:
        """The phrases of these numbers as text."""
        if [len(self.words), len(self.pairs)] != [len(t) for t in self.tables]:
            self.tables = (pa.array(list(self.words), pa.binary()),
                           np.fromiter(self.pairs, np.int64, len(self.pairs)))
        words, pairs = self.tables
        prefix, rest = keys >> HALF, keys & LOW
        out, order = [], []
        for longer in (False, True):
            at = np.flatnonzero((rest >= PAIR) == longer if of_pairs else (rest > 0) == longer)
            parts = [pairs[prefix[at]] >> HALF, pairs[prefix[at]] & LOW] if of_pairs else [prefix[at]]
            if of_pairs and longer:
                second = pairs[rest[at] - PAIR]
                parts += [second >> HALF, second & LOW]
            elif of_pairs or longer:
                parts.append(rest[at])
            out.append(pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in parts), b" "))
            order.append(at)
        back = np.argsort(np.concatenate(order))
        return pa.concat_arrays(out).take(pa.array(back)).cast(pa.string())


def pair_hashes(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair from the hashes of its words."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))
    h += np.uint64(xxhash.xxh64_intdigest(lang))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each hash in a filter of ``bits`` (a power of two)."""
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """The filter (bits in 64-bit words) of the phrases of two words in
    ``pairs`` (lang, phrase)."""
    size = 1 << FILTER_BITS

    def work(batches):
        for batch in batches:
            bits = [np.zeros(0, np.uint64)]
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                a, b = (np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" "))
                bits += probes(pair_hashes(lang, a, b), size)
            bits = np.unique(np.concatenate(bits))
            yield {"word": (bits >> np.uint64(6)).astype(np.int64),
                   "bits": (np.uint64(1) << (bits & np.uint64(63))).view(np.int64)}

    words = map_batches(pairs.select("lang", "phrase"), work, "word long, bits long").groupBy("word").agg(
        F.expr("bit_or(bits)").alias("bits")).toArrow()  # at most size / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def short_phrases(trie: Trie, a: np.ndarray) -> None:
    """Counts words and pairs of the numbers ``a``."""
    first, second = a[:-1], a[1:]
    pairs, n = np.unique((first << HALF | second)[(first > 0) & (second > 0)], return_counts=True)
    words = np.bincount(a)
    words[0] = 0
    own = np.flatnonzero(words)
    keys = np.concatenate([own << HALF, pairs])
    order = np.argsort(keys, kind="stable")
    trie.total += int(words.sum())
    trie.containers.add(keys[order], np.concatenate([words[own], n])[order])


def long_phrases(trie: Trie, a: np.ndarray, lang: str, frequent: np.ndarray, longest: int) -> None:
    """Counts phrases of three to ``longest`` words, all of whose pairs pass
    the filter."""
    pairs, which = np.unique(a[:-1] << HALF | a[1:], return_inverse=True)
    first, second = pairs >> HALF, pairs & LOW
    hashes = trie.word_hashes()
    good = (first > 0) & (second > 0)
    for bit in probes(pair_hashes(lang, hashes[first], hashes[second]), 64 * len(frequent)):
        good &= (frequent[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    number = np.zeros(len(pairs), np.int64)
    number[good] = np.fromiter(map(trie.pairs.__getitem__, pairs[good].tolist()), np.int64, int(good.sum()))
    good, pair = good[which], number[which]
    three = np.flatnonzero(good[:-1] & good[1:])
    keys = [pair[three] << HALF | a[three + 2]]
    if longest > 3:
        four = three[np.flatnonzero(good[np.minimum(three + 2, len(good) - 1)] & (three + 2 < len(good)))]
        keys.append(pair[four] << HALF | PAIR | pair[four + 2])
    trie.containers.add(*np.unique(np.concatenate(keys), return_counts=True))


def counted(texts: DataFrame, longest: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f): occurrences in ``texts`` (lang, text). Without a
    filter: of words and pairs, and under phrase '' the number of all words of
    the language. With one: of the phrases of three to ``longest`` words."""
    shared = None if frequent is None else texts.sparkSession.sparkContext.broadcast(frequent)
    burst, held, words, step = BURST, HELD, WORDS, STEP

    def work(batches):
        tries: dict[str, Trie] = {}

        def spill(keep):
            for lang, trie in tries.items():
                for keys, counts in trie.containers.spilled(keep // len(tries)):
                    for start in range(0, len(keys), SPILL_ROWS):
                        some = slice(start, start + SPILL_ROWS)
                        yield {"lang": pa.repeat(lang, len(keys[some])), "f": counts[some],
                               "phrase": trie.spelled(keys[some], shared is not None)}

        def add(lang, raws):
            trie = tries.get(lang)
            if trie is None:
                trie = tries[lang] = Trie(burst)
            a = np.concatenate([trie.numbers(raws), np.zeros(1, np.int64)])
            if shared is None:
                short_phrases(trie, a)
            else:
                long_phrases(trie, a, lang, shared.value, longest)

        for batch in slices(batches, max_bytes=step):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text.encode())
            for lang, raws in by_lang.items():
                add(lang, raws)
            many = len(tries) > burst  # languages
            if sum(t.containers.entries for t in tries.values()) > held:
                yield from spill(held // 2)
            if many or sum(len(t.words) + len(t.pairs) for t in tries.values()) > words:
                yield from spill(0)
                for lang, trie in list(tries.items()):
                    trie.forget()
                    if many:
                        if trie.total:
                            yield {"lang": [lang], "phrase": [""], "f": [trie.total]}
                        del tries[lang]
        yield from spill(0)
        if shared is None:
            found = {lang: t.total for lang, t in tries.items() if t.total}
            yield {"lang": list(found), "phrase": [""] * len(found), "f": list(found.values())}

    return (map_batches(texts.select("lang", "text"), work, "lang string, phrase string, f long")
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f")))


def exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def scored(frequent: DataFrame, factor: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more, by
    their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = (frequent.where(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
            .select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
            .select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"),
                    F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("rest")))
    of_first = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    of_rest = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(of_first, ["lang", "first"]).join(of_rest, ["lang", "rest"])
    score = F.expr(f"(CAST({factor} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div "
                   "(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return (both.groupBy("lang", "phrase", "a").agg(lowest.alias("low"))
            .select("lang", "phrase", "a", "low.l", "low.r", "low.score"))


def inside(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longest_f): the highest count of a longer phrase that the
    phrase (two words or more) lies in."""
    words = F.split("phrase", " ")
    parts = (frequent.where(F.size(words) > 2).select("lang", "f", words.alias("words"))
             .select("lang", "f", "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("n"))
             .select("lang", "f", "words", "n", F.explode(F.expr("sequence(1, size(words) - n + 1)")).alias("at"))
             .select("lang", "f", F.expr("array_join(slice(words, at, n), ' ')").alias("phrase")))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longest_f"))


def first_of_each(df: DataFrame, top: int) -> DataFrame:
    """``rank``, from 1, of the first ``top`` rows of each language by score and
    a descending, phrase ascending. Rows are dealt into groups by their phrase,
    each group keeps its first ones, and ``FAN_IN`` groups become one, until a
    language is one group: no task ranks more than FAN_IN * top rows after the
    first round."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    while True:
        out = (out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order)))
               .where(F.col("rank") <= top))
        if groups <= 1:
            return out.withColumn("rank", F.col("rank").cast("long")).drop("deal")
        groups = -(-groups // FAN_IN)
        out = out.drop("rank").withColumn("deal", F.pmod("deal", F.lit(groups)))


def collocations(df: DataFrame, longest: int = 4, min_count: int = 30, share: int = 80, top: int = 2000,
                 factor: int = 2_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r,
    n, score.

    Phrases have two to ``longest`` (at most 4) words and occur at least
    ``min_count`` times; those that lie in a longer one with ``share`` percent of
    their count are left out. Null text counts as empty, null language as
    ``und``; texts of no word add nothing, repeated rows count each, ties go by
    the bytes of the phrase. A language without a phrase has no rows, and so has
    an empty table. Other columns are not read.
    """
    if not 2 <= longest <= 4 or min_count < 1:
        raise ValueError("phrases have two to four words and occur at least once")
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    frequent = stored(counted(texts, longest).where((F.col("f") >= min_count) | (F.col("phrase") == "")), "phrases")
    totals = frequent.where("phrase = ''").select("lang", F.col("f").alias("n"))
    frequent = frequent.where((F.col("phrase") != "") & (F.col("f") >= min_count))
    if longest > 2:
        pairs = frequent.where(F.size(F.split("phrase", " ")) == 2)
        longer = stored(counted(texts, longest, pair_filter(pairs)).where(F.col("f") >= min_count), "long-phrases")
        frequent = frequent.unionByName(longer)
    found = scored(frequent, factor).join(inside(frequent), ["lang", "phrase"], "left")
    kept = found.where(F.col("longest_f").isNull()
                       | (exact("longest_f") * F.lit(100) < exact("a") * F.lit(share))).drop("longest_f")
    best = first_of_each(stored(kept, "scored-phrases"), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
