"""Repeats, language model, SimHash, line dedup, token counts and exact dedup
against brute force, and on odd tables."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellscope.llm import bytetree, components, counts, ctw, exact, lines, queries, repeats, simhash
from llm_cases import EDGE_ROWS, SF, documents, frame  # noqa: F401  (fixtures)

JSON = P.path("byte_bpe_50k.json")
WORDS = rb"[^\x20\x09-\x0D]+"


def lowered_words(text):
    return re.findall(WORDS, re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


# --- repeated passages

def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if cover[i] and not (i and cover[i - 1]))
        out.append((len(r), sum(cover), spans, bytes(x for x, y in zip(r, cover) if not y)))
    return out


def test_shorter_passages_are_reported_and_stay(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (30, 59, 60, 61, 90, 150)]
    texts = [word(50) + rng.choice(shared) + word(rng.randint(0, 40)) + rng.choice(shared) for _ in range(40)]
    texts += [None, "", word(200), texts[3], texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(df, length=60, passage=25).collect()}
    for i, (long, short) in enumerate(zip(brute_repeats(texts, 60), brute_repeats(texts, 25))):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passage) == (*long, short[1])


@pytest.mark.parametrize("length,alphabet", [(16, "ab é"), (50, "abcdefgh é"), (40, "ab")])
def test_repeats_equal_brute_force(spark, length, alphabet):
    rng = random.Random(length)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length - 5, 4 * length))) for _ in range(6)]
    texts = [None, "", "x" * 300, "ab" * 200, "x" * 250]
    for _ in range(50):
        texts.append("".join(
            rng.choice(passages)[rng.randint(0, 9):] if rng.random() < .5
            else "".join(rng.choice("abcdefghijk é") for _ in range(rng.randint(1, 2 * length)))
            for _ in range(rng.randint(0, 6))))
    texts += texts[10:13]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in repeats.remove_repeats(df, length).collect()}
    for i, want in enumerate(brute_repeats(texts, length)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want
        assert sum(s.end - s.start for s in r.spans) == want[1]


def test_records_of_long_texts_are_cut_without_loss():
    rng = random.Random(8)
    data = bytes(rng.choice(b"abcd") for _ in range(3000))
    array = np.frombuffer(data, np.uint8)
    whole = repeats.records(array, np.array([0]), np.array([3000]), 64, 32)
    positions = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[1], whole[2])])
    assert positions.tolist() == list(range(3000 - 64 + 1))
    # Equal strings have equal anchors at equal distances.
    twice = np.frombuffer(data[500:900] + b"#" + data[500:900], np.uint8)
    r = repeats.records(twice, np.array([0, 401]), np.array([400, 801]), 64, 32)
    first = {(f, la, a) for s, f, la, a in zip(*r[:4]) if s == 0}
    assert first == {(f - 401, la - 401, a - 401) for s, f, la, a in zip(*r[:4]) if s == 1}


def test_repeats_on_odd_rows(frame):
    got = repeats.remove_repeats(frame(EDGE_ROWS, "spans string, kept string, k1 string"), 400).collect()
    want = Counter((i, *w) for (i, _), w in zip(EDGE_ROWS, brute_long(EDGE_ROWS)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    empty = frame(EDGE_ROWS).limit(0)
    assert repeats.remove_repeats(empty).collect() == []
    out = repeats.without_repeats(frame(EDGE_ROWS), 400)
    assert out.columns == frame(EDGE_ROWS).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(
        (i, None if t is None else w[3].decode(errors="ignore"))
        for (i, t), w in zip(EDGE_ROWS, brute_long(EDGE_ROWS)))
    with pytest.raises(ValueError):
        repeats.remove_repeats(empty, 8)


def brute_long(rows, length=400):
    """The edge rows have one text that repeats within itself: a brute force
    by hashes instead of strings."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(r[i:i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[hash(r[i:i + length])] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        cover = np.cumsum(cover)[:len(r)] > 0
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((len(r), int(cover.sum()), spans, np.frombuffer(r, np.uint8)[~cover].tobytes()))
    return out


# --- language model

def brute_mixture(texts):
    """A function (text) -> log10 probability, straight from the definition."""
    depth, count = bytetree.DEPTH, Counter()

    def paths(raw):
        for k, byte in enumerate(raw):
            h = tuple(raw[k - j] if k >= j else 0 for j in range(1, depth + 1))
            yield byte, [h[:d] for d in range(depth + 1)]

    children = defaultdict(set)
    for raw in texts:
        for byte, path in paths(raw):
            node = 1
            for bit in range(7, -1, -1):
                q = byte >> bit & 1
                for z in path:
                    count[z, node, q] += 1
                    if z:
                        children[z[:-1], node].add(z)
                node = node * 2 + q

    def kt(z, node):
        a, b = count[z, node, 0], count[z, node, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @functools.cache
    def weighted(z, node):
        if len(z) == depth:
            return kt(z, node)
        return math.log(.5) + np.logaddexp(kt(z, node), sum(weighted(c, node) for c in children[z, node]))

    def one(path, node):
        out, left = 0, 1
        for z in path:
            a, b = count[z, node, 0], count[z, node, 1]
            if not a + b:
                return out + left / 2
            share = 1 if len(z) == depth else math.exp(math.log(.5) + kt(z, node) - weighted(z, node))
            out += left * share * (b + .5) / (a + b + 1)
            left *= 1 - share
        return out

    def score(raw):
        total = 0
        for byte, path in paths(raw):
            node = 1
            for bit in range(7, -1, -1):
                q, p = byte >> bit & 1, one(path, node)
                total += math.log10(p if q else 1 - p)
                node = node * 2 + q
        return total

    return score


def score_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "Hello", "abracadabra", "é", "ñandú", "x", "\x00\x01", "\n", "zz zz"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(n)] + [
        (n, None), (n + 1, ""), (n + 2, "a"), (n + 3, "the of the of " * 40), (n + 3, "never seen QQQ")]


@pytest.mark.parametrize("range_grams,sampled", [(10**9, 1 << 30), (200, 2), (12, 1)])
def test_scores_equal_the_definition(spark, range_grams, sampled):
    # One range, several, and so many that every context is cut.
    rows = score_rows(60)
    lowered = [(i, (t or "").encode().lower()) for i, t in rows]
    want = brute_mixture([t for i, t in lowered if zlib.crc32(str(i).encode()) % 7 != 2])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ctw.score(df, range_grams=range_grams, sampled=sampled).collect()
    key = lambda r: (r[0], r[1])
    for (i, n, score), (j, m, brute) in zip(sorted(((r.doc_id, r.n_bytes, r.score) for r in got), key=key),
                                            sorted(((i, len(t), want(t)) for i, t in lowered), key=key)):
        assert (i, n) == (j, m) and math.isclose(score, brute, rel_tol=1e-5, abs_tol=1e-5)


def test_grams_do_not_reach_over_texts():
    texts = [b"abcdefghijkl", b"", b"xy", b"z", b"0123456789"]
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    want = []
    for t in texts:
        for k, byte in enumerate(t):
            near = [t[k - j] if k >= j else 0 for j in range(1, bytetree.DEPTH + 1)]
            want.append(int.from_bytes(bytes(near) + bytes([byte]), "big"))
    for step in (3, 5, 100):
        got = [bytetree.grams(data, starts, a, min(len(data), a + step)) for a in range(0, len(data), step)]
        assert np.concatenate(got).tolist() == want


def test_distinct_grams_and_their_counts():
    rng = np.random.default_rng(5)
    for n, m in ((0, 0), (0, 9), (9, 0), (300, 200), (300, 1), (1, 300)):
        a, b = (rng.integers(0, 50, k).astype(np.uint64) << np.uint64(58) for k in (n, m))
        want = {g: 0 for g in b.tolist()} | dict(Counter(a.tolist()))
        got = bytetree.distinct(a.copy(), b.copy())
        assert dict(zip(*(x.tolist() for x in got))) == want and got[0].tolist() == sorted(want)
        assert bytetree.united([np.unique(a), np.unique(b)])[0].tolist() == sorted(want)


def test_texts_of_bytes():
    ends = np.cumsum([3, 0, 0, 5, 1, 0, 4])
    want = [0] * 3 + [3] * 5 + [4] + [6] * 4
    for a in range(13):
        for b in range(a + 1, 14):
            assert bytetree.texts_of(ends, a, b).tolist() == want[a:b]


def test_word_numbers_are_those_of_the_lowered_words():
    texts = ["", " a B  a\t", "".join(map(chr, range(300))) * 2, "\u00a0x\x85y\x1cz \x0b\x0c\r\nİ", "A"]
    terms = ctw.Terms()
    spelled = {}
    for t, numbers in zip(texts, ctw.word_numbers(texts, terms)):
        spelled[t] = [list(terms)[n] for n in numbers]
    assert spelled == {t: ctw.lowered(t).split() + [ctw.END] for t in texts}


def test_requests_are_put_together_once(spark, monkeypatch):
    # They were stored as they came and shuffled twice; a range is one row now.
    kept, whole = [], bytetree.stored

    def stored(df, name):
        out = whole(df, name)
        kept.append(name)
        if name == "ranges":
            rows = out.where("grams IS NOT NULL")
            assert rows.count() == rows.select("range").distinct().count() > 1
        return out

    monkeypatch.setattr(bytetree, "stored", stored)
    df = spark.createDataFrame(score_rows(25), "doc_id long, text string").repartition(3)
    ctw.score(df, range_grams=200, sampled=2).collect()
    assert "ranges" in kept and "requests" not in kept


def test_krichevsky_trofimov_of_small_and_large_counts():
    zeros, ones = np.array([0, 1, 5, 127, 128, 10**6, 3 * 10**7]), np.array([0, 0, 127, 127, 3, 10**7, 1])
    want = [math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)
            for a, b in zip(zeros.tolist(), ones.tolist())]
    assert np.allclose(bytetree.log_kt(zeros, ones), want, rtol=1e-7, atol=1e-6)


def brute_base(rows):
    tokens = [(i, lowered_words(t) + [None]) for i, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    count = Counter(w for (_, ws), used in zip(tokens, train) if used for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, not used, len(ws), sum(count[w] > 0 for w in ws), n,
             sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (i, ws), used in zip(tokens, train)]


def matches_base(got, want):
    key = lambda r: (str(r[0]), r[2], r[3], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_scores_query(spark, documents):
    got = queries.op5_context_tree(spark, SF).collect()
    matches_base(got, brute_base([(r.doc_id, r.text) for r in documents.collect()]))
    # The tree learns: held-out texts take far fewer bits than eight a byte.
    held = [r for r in got if r.held_out and r.n_bytes]
    assert 0 < np.mean([r.bits_per_byte for r in held]) < 4


def test_scores_on_odd_rows(frame):
    got = ctw.score(frame(EDGE_ROWS, "score string, block string")).collect()
    matches_base(got, brute_base(EDGE_ROWS))
    assert all(r.score == 0 and r.bits_per_byte is None for r in got if not r.n_bytes)
    assert ctw.score(frame(EDGE_ROWS).limit(0)).collect() == []
    empty = [(1, None), (2, ""), (None, "")]
    assert [(r.n_tokens, r.score, r.bits_per_byte) for r in ctw.score(frame(empty)).collect()] == [(1, 0, None)] * 3
    held = [(i, "only held out") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    for r in ctw.score(frame(held)).collect():
        assert r.train_tokens == r.n_known == 0 and math.isclose(r.bits_per_byte, 8, rel_tol=1e-6)


# --- SimHash

def brute_fingerprint(text):
    words = lowered_words(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(prints, np.uint64)
    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1:] ^ array[k]) <= distance) + k + 1:
            a, b = find(k), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def test_simhash_query(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", rows[g][0]) for (i, _), p, g in zip(rows, prints, group)}


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_gray_index_links_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):  # chains and dense groups
            prints.add(base)
            base ^= 1 << rng.randint(0, 63)
            if rng.random() < .3:
                base ^= 1 << rng.randint(0, 63)
    prints = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    links = simhash.linked(spark.createDataFrame([(p,) for p in prints], "fp long"), distance)
    found = {r.node: r.component for r in components.components(links).collect()}
    want = brute_components(np.array(prints, np.int64).view(np.uint64).tolist(), distance)
    assert [found.get(p, p) for p in prints] == [prints[w] for w in want]


def test_gray_index_search_is_complete():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) >> np.uint64(40) << np.uint64(3)
    prints = prints[np.argsort(simhash.gray_rank(prints))]
    index, asked = simhash.GrayIndex(prints), prints[::7] ^ np.uint64(9)
    found = {(int(q), int(n)) for qs, ns in index.search(asked, 2) for q, n in zip(qs, ns)}
    near = np.bitwise_count(asked[:, None] ^ prints[None, :]) <= 2
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_gray_ranks_are_in_gray_order():
    ranks = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_simhash_on_odd_rows(frame):
    df = frame(EDGE_ROWS, "fp string, fingerprint string, least string")
    got = simhash.near_duplicates(df).collect()
    prints = [brute_fingerprint(t) for _, t in EDGE_ROWS]
    group = brute_components(prints)
    names = {g: min((i for (i, _), h in zip(EDGE_ROWS, group) if h == g and i is not None), default=None)
             for g in group}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        (i, f"{p:016x}", names[g]) for (i, _), p, g in zip(EDGE_ROWS, prints, group))
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 3} and 2 not in {r.doc_id for r in kept.collect()}


def test_one_row_of_each_component_stays(frame):
    """Null ids, an id with two texts, and repeated rows, against brute force."""
    rows = EDGE_ROWS + [(7, "no id"), (None, "a lone row"), (None, "a lone row"), (8, "one two three"),
                        (8, "a text of its own"), (9, "a text of its own"), (2, "the second text of two")]
    group = brute_components([brute_fingerprint(t) for _, t in rows])
    members = defaultdict(list)
    for (i, t), g in zip(rows, group):
        members[g].append((i is None, i or 0, t))
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(frame(rows)).collect()]
    assert len(kept) == len(members)
    assert Counter(i for i, _ in kept) == Counter(
        None if least[0] else least[1] for least in (min(m, key=lambda x: x[:2]) for m in members.values()))
    left = Counter(group[rows.index(r)] for r in kept)
    assert set(left.values()) == {1} and set(left) == set(members)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- line dedup

def word_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def lines_alike(w, v, units):
    """Equal words; or of enough words, or else of enough characters, one is
    inserted, deleted or replaced."""
    if w == v:
        return True
    if min(len(w), len(v)) >= units:
        return abs(len(w) - len(v)) <= 1 and word_distance(w, v) <= 1
    if max(len(w), len(v)) >= units:
        return False
    x, y = (b" ".join(line).decode() for line in (w, v))
    return min(len(x), len(y)) >= units and abs(len(x) - len(y)) <= 1 and word_distance(x, y) <= 1


def brute_lines(docs, units):
    found = [(i, n, line.encode().split()) for i, t in docs for n, line in enumerate((t or "").split("\n"))]
    found, gone = [x for x in found if x[2]], set()
    for at, (i, n, w) in enumerate(found):
        if any(lines_alike(w, v, units) for _, _, v in found[:at]):
            gone.add((i, n))
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in docs}


@pytest.mark.parametrize("a,b,alike", [
    ("Copyright 2021 Foo", "Copyright 2022 Foo", True), ("All rights reserved", "All rights reserved.", True),
    ("All rights reserved", "All rightsreserved", True), ("Überschrift zwei", "Überschrift drei", False),
    ("Überschriften", "Uberschriften", True), ("page 1", "page 2", False), ("a b c d e", "a b c d f", False),
    ("next page x", "last page x", False)])
def test_short_lines_differ_by_a_character(spark, a, b, alike):
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in lines.line_dedup(df).collect()}
    assert got == {1: a, 2: "" if alike else b} == brute_lines([(1, a), (2, b)], 10)


@pytest.mark.parametrize("units", [4, 10])
def test_lines_equal_brute_force(spark, units):
    rng = random.Random(units)
    few = "a b c d e".split()

    def line():
        return [rng.choice(few + [f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 14))]

    def edited(words):
        words = list(words)
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            at, kind = rng.randrange(len(words)) if words else 0, rng.randint(0, 2)
            if kind == 0 or not words:
                words.insert(at, rng.choice(few))
            elif kind == 1:
                del words[at]
            else:
                words[at] = rng.choice(few)
        return " ".join(words)

    pool = [line() for _ in range(40)]
    docs = [(0, None), (1, ""), (2, "\n\n \n")] + [
        (i, "\n".join(edited(rng.choice(pool)) if rng.random() < .7 else " ".join(line())
                      for _ in range(rng.randint(1, 8)))) for i in range(3, 90)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line int")
    got = {r.doc_id: r.kept for r in lines.line_dedup(df, edit_units=units).collect()}
    assert got == brute_lines(docs, units)


def test_within_one_word():
    rng = random.Random(6)
    for _ in range(2000):
        a, b = ([rng.choice([b"x", b"y"]) for _ in range(rng.randint(0, 6))] for _ in range(2))
        assert lines.within_one(a, b) == (word_distance(a, b) <= 1)


def test_lines_on_odd_rows(frame):
    df = frame(EDGE_ROWS, "pos string, keys string, line string")
    got = Counter((r.doc_id, r.n_removed, r.kept) for r in lines.line_dedup(df).collect())
    assert sum(got.values()) == len(EDGE_ROWS)
    # Identical rows count as one; the same line under a later id goes.
    assert got[1, 0, "one two three"] == 2 and got[2, 1, ""] == 1 and got[3, 0, ""] == 1
    assert lines.line_dedup(df.limit(0)).collect() == []
    out = lines.without_duplicate_lines(df)
    assert out.columns == df.columns
    assert {r.text for r in out.where("doc_id = 3").collect()} == {None}


# --- token counts

def test_token_counts(spark, documents, frame):
    library = Tokenizer.from_file(JSON)

    def want(rows):
        return Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids),
                        n > 1024) for i, t in rows)

    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(tuple(r) for r in queries.op9_token_counts(spark, SF).collect()) == want(rows)
    df = frame(EDGE_ROWS + [(8, "a  b \n c<|endoftext|>  ")], "n_tokens string, block string, bucket string")
    got = counts.token_counts(df, JSON, P.PATTERN).collect()
    assert Counter(tuple(r) for r in got) == want(EDGE_ROWS + [(8, "a  b \n c<|endoftext|>  ")])
    assert counts.token_counts(df.limit(0), JSON, P.PATTERN).collect() == []


# --- exact dedup

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_exact_on_odd_rows_and_a_hot_group(frame, keep, best):
    rows = EDGE_ROWS + [(100 + i, "hot text") for i in range(400)] + [(None, "hot text"), (1000, "Hot text")]
    got = exact.exact_dedup(frame(rows, "size string, edge string, keep_id string"), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in rows:
        ids = groups[t or ""]
        name = best((x for x in ids if x is not None), default=None)
        want[i, name, len(ids), i == name, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact.exact_dedup(frame(rows).limit(0)).collect() == []


def test_exact_normalisation(frame):
    df = frame([(1, "A  b\n"), (2, "a b"), (3, "A b")])
    sizes = {n: sorted(r.group_size for r in exact.exact_dedup(df, normalise=n).collect()) for n in exact.NORMALISE}
    assert sizes == {"none": [1, 1, 1], "space": [1, 2, 2], "lower": [1, 2, 2]}
    with pytest.raises(ValueError):
        exact.exact_dedup(df, keep="any")


def test_hot_shares_of_a_third(spark):
    """A third of all rows are one text, with one line and one passage."""
    rng = random.Random(9)
    common = " ".join(f"w{rng.randint(0, 999)}" for _ in range(120))
    rows = [(i, common if i % 3 == 0 else " ".join(f"v{rng.randint(0, 9999)}" for _ in range(60)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact.exact_dedup(df).where(F.col("group_size") == 100).count() == 100
    assert lines.line_dedup(df).where("n_removed = 1").count() == 99
    assert repeats.remove_repeats(df).where("n_removed = n_bytes").count() == 100
    groups = simhash.near_duplicates(df).groupBy("component_id").count().collect()
    assert max(r["count"] for r in groups) == 100
