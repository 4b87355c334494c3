"""Jaccard join, whitening and collocations against brute force, and on odd
tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cellscope.llm import jaccard, phrases, queries, whitening
from llm_cases import EDGE_ROWS, SF, documents, frame  # noqa: F401  (fixtures)


# --- Jaccard join

def shingle_set(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, percent=80, size=5):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in lists[s])
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in own:
            lists[s].append(i)
    named = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            named[root(i)].append(doc)
    return Counter((doc, len(sets[i]), min(named[root(i)], default=None)) for i, (doc, _) in enumerate(rows))


def found_components(df, **more):
    return Counter(tuple(r) for r in jaccard.jaccard_components(df, **more).collect())


def planted_rows(seed, groups=12, members=14):
    """Chains of edits: members are alike their neighbours, not all of each
    other; small and large sets, a passage that many share, exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(groups):
        length = [6, 9, 12, 20, 45, 120, 400][g % 7]
        text = [word() for _ in range(length)]
        if g % 3 == 0:
            text += passage
        for _ in range(members):
            rows.append(" ".join(text))
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                at = rng.randrange(len(text))
                text = text[:at] + [word()] + text[at + rng.randint(0, 1):]
    rows += [" ".join(passage + [word() for _ in range(6)]) for _ in range(40)]
    rows += rows[:20]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_components_equal_brute_force(spark):
    rows = planted_rows(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_components(df, percent=60) == brute_components(rows, 60)


def test_light_and_heavy_sets_meet(spark, monkeypatch):
    rows = planted_rows(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for boundary in (20, 10**9):  # some light, all light
        monkeypatch.setattr(jaccard, "chosen_boundary", lambda sets, percent, b=boundary: b)
        assert found_components(df) == want


def test_lists_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 3)
    rows = planted_rows(6, groups=9, members=10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(df) == brute_components(rows)


def test_without_pivots_the_blocks_find_all_links(spark, monkeypatch):
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(jaccard, "verified", lambda *a: none)  # nor the spanning forest
    rows = planted_rows(7, groups=7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(df) == brute_components(rows)


def test_jaccard_on_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op11_jaccard_join(spark, SF).collect()) == brute_components(rows)


def test_jaccard_on_odd_rows(spark, frame):
    rows = EDGE_ROWS + [(None, "long word " * 30_000 + "z" * 50_000), (None, "one two three"), (8, " \t\n")]
    got = found_components(frame(rows, "component_id string, node string, key int, n int, tokens string"))
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(frame(rows).limit(0)).collect() == []
    assert found_components(frame([(1, None), (2, ""), (None, None)])) == {(1, 0, 1): 1, (2, 0, 2): 1, (None, 0, None): 1}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for n in (5, 300, 1500, 6000)]
    for own in list(sets):
        sets.append(np.unique(np.concatenate([own[rng.random(len(own)) < .8], own[:20] + np.uint64(1)])))
    bitmaps = jaccard.Bitmaps([jaccard.bitmap(s) for s in sets])
    assert len(bitmaps.tables) > 2
    for i, a in enumerate(sets):
        differing = bitmaps.apart(i)
        for j, b in enumerate(sets):
            assert differing[j] <= len(np.setxor1d(a, b)) and (i != j or differing[j] == 0)
            assert differing[j] == bitmaps.apart(j)[i]


# --- whitening

def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def check_whitening(rows, got, k=4):
    """Against numpy's eigenvectors, up to the sign of a component."""
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = {i: (v - sums / n) @ axes / np.sqrt(values) for i, v in x.items()}
    signs = np.sign(sum(np.array([r.whitened for r in sorted(got[i], key=lambda r: r.component)]) * want[i] for i in x))
    trace = np.cov(fit.T, bias=True).trace()
    for i, own in got.items():
        own = sorted(own, key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in own} == {(n, int(((n * x[i] - sums) ** 2).sum()))}
        assert np.allclose([r.whitened for r in own] * signs, want[i], atol=1e-8)
        assert np.allclose([r.explained for r in own], values / trace, rtol=1e-9)
        assert {r.identity_error for r in own}.pop() < 1e-9


def by_id(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.vec_id].append(r)
    return found


@pytest.mark.parametrize("d,n,seed", [(64, 300, 1), (120, 400, 2), (5, 50, 3)])
def test_whitening_equals_numpy(spark, d, n, seed):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, d)) * np.linspace(1.0, 0.5, d)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    # Copies of one vector, a third of all rows, are fitted once.
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]
    check_whitening(rows, by_id(whitening.whiten(vectors(spark, rows).repartition(4))))


def test_whitening_of_given_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(rows, by_id(queries.op12_whitening(spark, SF)))


def test_close_eigenvalues_are_told_apart(spark):
    # The fourth and fifth values differ by a thousandth.
    rng = np.random.default_rng(4)
    scale = np.sqrt(np.array([4, 3, 2, 1.001, 1.0] + [0.999 - i / 500 for i in range(59)]))
    q = np.linalg.qr(rng.standard_normal((2000, 64)))[0] * math.sqrt(2000)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate((q - q.mean(axis=0)) * scale)]
    check_whitening(rows, by_id(whitening.whiten(vectors(spark, rows))))


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float((i * 7) % 11), float(i % 3), 1.5 * i]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, -inf, 1.0]), (104, []),
           (105, [1.0, 2.0])]
    rows = [(i, v, 7, "x") for i, v in good + bad]
    df = vectors(spark, rows, ", component int, whitened string")
    check_whitening(good, by_id(whitening.whiten(df, k=3)), k=3)
    null_id = by_id(whitening.whiten(vectors(spark, good + [(None, good[0][1])] * 2), k=1))
    assert len(null_id[None]) == 2 and null_id[None][0].whitened == null_id[0][0].whitened
    for few in ([], bad[:5], [(1, [1.0, 2.0])] * 3):  # nothing, nothing usable, one distinct vector
        assert whitening.whiten(vectors(spark, few)).collect() == []
    line = by_id(whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])))
    assert {len(r) for r in line.values()} == {1}  # one direction, one component
    big = [(i, [1e12 * (i % 5), float(i)]) for i in range(10)]
    with pytest.raises(Exception):
        whitening.whiten(vectors(spark, big)).collect()


def test_whitening_is_certified(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whiten(table).select("component", "explained", "residual").distinct().collect()
    assert len(got) == 4 and all(r.residual < 1e-9 for r in got)


# --- collocations

def brute_collocations(rows, longest=4, min_count=30, share=80, top=2000, factor=2_000_000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", raw):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    covered = Counter()
    for (lang, g), a in candidates.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                covered[lang, g[i:i + m]] = max(covered[lang, g[i:i + m]], a)
    found = defaultdict(list)
    for (lang, g), a in candidates.items():
        if covered[lang, g] and 100 * covered[lang, g] >= share * a:
            continue
        score, _, left, right = min((factor * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]])
                                    for k in range(1, len(g)))
        found[lang].append((-score, -a, b" ".join(g), left, right))
    return sorted((lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
                  for lang, own in found.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1))


def found_collocations(df, **more):
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


def text_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "c", "é", "Ab", "zz", " ", "x" * 40, "d", "e", "f"]
    ends = [" ", " ", " ", "\t", "  ", ". ", "\n", "; ", "\x0b", "?!"]
    return [(rng.choice(["en", "en", "en", None, "fr", "und", ""]),
             "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 90)))) for _ in range(n)]


@pytest.mark.parametrize("longest,top", [(4, 2000), (4, 7), (3, 2000), (2, 50)])
def test_collocations_equal_brute_force(spark, longest, top):
    rows = text_rows(longest + top)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = found_collocations(df, longest=longest, min_count=5, top=top)
    assert got == brute_collocations(rows, longest, 5, top=top) and len(got) > 20


def test_spills_bursts_and_full_word_tables_change_nothing(spark, monkeypatch):
    rows = text_rows(9, 200)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = brute_collocations(rows, min_count=4)
    for name, value in (("BURST", 3), ("HELD", 40), ("WORDS", 6), ("STEP", 300)):
        monkeypatch.setattr(phrases, name, value)
    assert found_collocations(df, min_count=4) == want
    monkeypatch.setattr(phrases, "FILTER_BITS", 8)  # a filter that lets nearly all through
    assert found_collocations(df, min_count=4) == want


def test_containers_burst_and_keep_their_runs():
    trie, flat = phrases.Containers(100), Counter()
    rng = random.Random(1)
    for _ in range(8):
        keys = sorted({rng.choice([3, 4, 5, rng.randrange(1000)]) << 32 | rng.randrange(900) for _ in range(900)})
        trie.add(np.array(keys), np.full(len(keys), 2))
        flat.update(dict.fromkeys(keys, 2))
    assert trie.entries == len(flat) == sum(map(len, trie.tables)) and len(trie.tables) > 10
    for start, stop, table in zip(trie.starts, trie.starts[1:] + [10**9], trie.tables):
        assert all(start <= k >> 32 < stop for k in table)
        assert len(table) <= 100 or len({k >> 32 for k in table}) == 1
    some = dict(kv for keys, counts in trie.spilled(1000) for kv in zip(keys.tolist(), counts.tolist()))
    assert 0 < trie.entries <= 1000
    for keys, counts in trie.spilled(0):
        assert (np.diff(keys) > 0).all()
        some |= dict(zip(keys.tolist(), counts.tolist()))
    assert some == flat and trie.entries == 0


def test_collocations_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.sql(queries.ORACLE_SQL["op13_collocations"])
    got = queries.op13_collocations(spark, SF).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rel.fetchall()) and got


def test_collocations_of_odd_rows(spark, frame):
    kinds = "lang string, text string, rank int, phrase string, f int, n string"
    odd = [(None, None, 1, "p", 2, "n"), ("en", "", 1, "p", 2, "n"), ("en", " .\t\n ", 1, "p", 2, "n")]
    assert phrases.collocations(spark.createDataFrame(odd, kinds)).collect() == []
    assert phrases.collocations(spark.createDataFrame([], kinds)).collect() == []
    long = [("fr", "one two " * 40_000, 1, "p", 2, "n"), (None, "one two " * 30, 1, "p", 2, "n")] * 2
    got = found_collocations(spark.createDataFrame(odd + long, kinds))
    assert got == brute_collocations([r[:2] for r in odd + long]) and {r[0] for r in got} == {"fr", "und"}


def test_ranking_in_rounds(spark):
    rows = [("en", f"p{i:05d}", i % 7, i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a int, score int").repartition(9)
    got = [(r.phrase, r["rank"]) for r in phrases.first_of_each(df, 50).orderBy("rank").collect()]
    want = sorted(rows, key=lambda r: (-r[3], -r[2], r[1]))[:50]
    assert got == [(r[1], i) for i, r in enumerate(want, 1)]
