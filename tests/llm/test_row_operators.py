"""BPE, packing, URL filter and quality rules against the libraries and brute
force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellscope.llm import bpe, packing, quality, queries, tokens, urls
from llm_cases import EDGE_ROWS, SF, documents, frame  # noqa: F401  (fixtures)

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def multi():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.load_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_json_and_rank_file_hold_the_same_ranks():
    assert tokens.load_ranks(JSON) == tokens.load_ranks(P.path("byte_bpe_50k.tiktoken"))


def random_texts(rng, n):
    parts = ["the", "Straße", "naïve", "日本語", "  ", " ", "\n", "\t", "\u00a0", "'s", "12", "!!", "😀", "aaaa", "\r\n", "x" * 40]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_chunked_encoding_equals_the_library(multi, library):
    rng = random.Random(1)
    own, fast = bpe.worker_table(MULTI, P.PATTERN), tokens.library_encoder(JSON, P.PATTERN)
    for text in random_texts(rng, 1500) + ["", " ", "a <|endoftext|>b", "<|endoftext|><|endoftext|> "]:
        assert np.frombuffer(own(text), "<u4").tolist() == multi.encode_ordinary(text)
        assert np.frombuffer(fast(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_prefix_table_appends_and_edits_exactly(multi):
    vocabulary, rng = bpe.worker_vocabulary(MULTI), random.Random(2)
    for _ in range(150):
        data = bytes(rng.choice(b"abcdeth \xc3\xa9") for _ in range(rng.randint(1, 120)))
        table = bpe.PrefixTable(vocabulary, data[:20])
        table.append(data[20:])
        assert table.ids() == vocabulary.merge(data)
        start = rng.randint(0, len(data))
        stop = rng.randint(start, min(len(data), start + 6))
        new = bytes(rng.choice(b"abth") for _ in range(rng.randint(0, 5)))
        table.replace(start, stop, new)
        assert table.ids() == vocabulary.merge(data[:start] + new + data[stop:])
        # Every prefix is encoded as well.
        end = rng.randint(0, len(table.data))
        assert bpe.PrefixTable(vocabulary, b"", table.last[:end]).last == table.last[:end]


def test_an_edit_encodes_only_near_it():
    vocabulary = bpe.worker_vocabulary(MULTI)
    table = bpe.PrefixTable(vocabulary, b"abcde fghij " * 2000)
    assert table.replace(6000, 6001, b"zz") < 500


def test_vocabulary_whose_merges_are_not_in_rank_order():
    ranks = {bytes([b]): i + 10 for i, b in enumerate(b"abc")} | {b"ab": 14, b"abc": 5}
    vocabulary = bpe.Vocabulary(ranks)
    for data in (b"abc", b"abcab", b"cabcb"):
        assert bpe.PrefixTable(vocabulary, data).ids() == vocabulary.merge(data)


def test_tokens_grown_by_a_byte():
    vocabulary = bpe.worker_vocabulary(MULTI)
    built = vocabulary.built
    assert vocabulary.grown == {(built[t[:-1]] if len(t) > 1 else vocabulary.none) * 256 + t[-1]: rank
                                for t, rank in built.items() if len(t) == 1 or t[:-1] in built}


def test_packed_ids():
    for ids in ([], [0], [1, 256, 65536, 2**32 - 1]):
        assert bpe.packed_few(ids) == tokens.packed(ids)


def test_words_that_come_again_are_encoded_once(monkeypatch):
    # More words than the tables held: they were encoded again on every pass.
    asked = []
    monkeypatch.setattr(bpe, "encode_piece", lambda _, piece: asked.append(piece) or [len(piece)])
    bpe.worker_table.cache_clear()
    letters = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(str(i) for i in range(290_000)).translate(letters)
    table = bpe.worker_table(MULTI, P.PATTERN)
    assert table(text) == table(text)
    bpe.worker_table.cache_clear()
    assert len(asked) == len(set(asked)) == 290_000


def test_bpe_query_equals_the_library(spark, documents, multi):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = queries.op2_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = multi.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(tokens.packed(ids)).hexdigest(),
            hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_on_odd_rows(frame, multi):
    df = frame(EDGE_ROWS, "ids string, decoded string")
    got = bpe.decode(bpe.encode(df, MULTI, P.PATTERN), MULTI).collect()
    want = Counter((i, tuple(multi.encode_ordinary(t or "")), (t or "").encode()) for i, t in EDGE_ROWS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(df.limit(0), MULTI, P.PATTERN).collect() == []


def check_pieces(got, texts, library, capacity=2048):
    """Pieces cover each document's ids once, in order, and fill sequences
    without gaps; returns the share of padding."""
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in texts)
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, pieces in by_doc.items():
        ids = [ids for (d, ids) in want if d == i]
        if len(ids) == 1 and want[i, ids[0]] == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids[0])
                assert zlib.crc32(tokens.packed(ids[0][at:at + r.length])) == zlib.crc32(bytes(r.ids))
                at += r.length
            assert at == len(ids[0])
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(r.length for r in got)


def test_packing_query_rows(spark, documents, library):
    got = packing.pack(documents, JSON, P.PATTERN).collect()
    assert check_pieces(got, [(r.doc_id, r.text) for r in documents.collect()], library) < 0.01
    assert spark.sparkContext.defaultParallelism >= 1


def test_packing_on_odd_rows(frame, library):
    df = frame(EDGE_ROWS, "start string, ids string")
    check_pieces(packing.pack(df, JSON, P.PATTERN, capacity=100, min_piece=10).collect(), EDGE_ROWS, library, 100)
    assert packing.pack(df.limit(0), JSON, P.PATTERN).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, JSON, P.PATTERN, min_piece=0)


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        name, slash, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + prefix):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return host, path, *(best or (None, None))


def test_url_rules_and_odd_urls(spark):
    odd = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://A.net/x", "x://xnet/", "http://example.net/en",
           "http://example.net/en/", "http://a.example.com/de/?q#f", "http://example.com/fr/", "http://é.ORG/fr/1",
           "http://org/fr/", "http://a?x=http://b.net/", "http://b.net/\nnew", "http://net/" + "y" * 5000, "://net/"]
    urls_ = [(i, u, "h") for i, u in enumerate(odd + odd)] + [(None, "http://a.net/", "h")]
    df = spark.createDataFrame(urls_, "page_id long, url string, host string")
    got = urls.url_filter(df, queries.URL_RULES).collect()
    assert len(got) == len(urls_)
    by_url = {u: brute_rule(u, queries.URL_RULES) for _, u, _ in urls_}
    ids = {i: u for i, u, _ in urls_}
    for r in got:
        host, path, rule, verdict = by_url[ids[r.page_id]]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)
    assert urls.url_filter(df.limit(0), queries.URL_RULES).collect() == []


def test_url_model_against_brute_force_and_held_out(spark):
    # The smoothed probabilities of all next characters sum to one.
    counts = {"": {"a": 3, "b": 1}, "a": {"b": 2, "\x03": 1}, "ab": {"a": 1}}
    model = urls.MarkovModel(counts, 2, alphabet=4)

    def p(context, char):
        out = 1 / 4
        for length in range(3):
            after = counts.get(context[len(context) - length:] if length else "")
            if after is None:
                break
            out = (after.get(char, 0) + len(after) * out) / (sum(after.values()) + len(after))
        return out

    assert abs(sum(p("ab", c) for c in ("a", "b", "c", "\x03")) - 1) < 1e-12
    padded = "\x02\x02" + "abc" + "\x03"
    assert math.isclose(model.log2("abc"), sum(math.log2(p(padded[i - 2:i], padded[i])) for i in range(2, 6)))
    # Unruled URLs that look like one side get that side's verdict.
    rng = random.Random(4)
    rows = [(i, f"http://{'spam' if i % 2 else 'news'}{rng.randint(0, 99)}.{'net' if i % 2 else 'org'}/fr/{rng.randint(0, 9999)}")
            for i in range(400)]
    rows += [(1000 + i, f"http://{'spam' if i % 2 else 'news'}{rng.randint(0, 99)}.info/fr/1") for i in range(100)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()
    held = [r for r in got if r.page_id >= 1000]
    assert sum(r.verdict == ("block" if r.page_id % 2 else "allow") for r in held) >= 0.9 * len(held)


def brute_statistics(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")),
            duplicates, len(covered))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_statistics_and_held_out_accuracy(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op6_quality(spark, SF).collect()
    assert len(got) == len(texts)
    right = total = 0
    for r in got:
        stats = brute_statistics(texts[r.doc_id])
        assert tuple(r[c] for c in BASE) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            total += 1
            right += r.kept == bool(labels[r.doc_id])
    assert total and right / total >= 0.9


def test_a_hot_labelled_id_is_fitted_once(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    hot = labels.where("quality = 0").orderBy("doc_id").first().doc_id
    rows = documents.select("doc_id", "text")
    # A third of all rows have one id, with many texts; that of least hash is fitted.
    copies = spark.range(100).selectExpr(f"{hot}L AS doc_id", "concat('copy number ', id, repeat(' and more', 60)) AS text")
    many = rows.unionByName(copies)
    first = many.where(f"doc_id = {hot}").orderBy(F.xxhash64("text")).limit(1)
    one = rows.where(f"doc_id <> {hot}").unionByName(first)
    a, b = (quality.fit(df, labels, "doc_id", "text", "doc_id", "quality") for df in (many, one))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_quality_on_odd_rows(spark, frame):
    df = frame(EDGE_ROWS + [(9, "a b c a b c\na b c a b c\n\n")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.quality(df, labels).collect()
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in got) == \
        Counter((i, *brute_statistics(t)) for i, t in EDGE_ROWS + [(9, "a b c a b c\na b c a b c\n\n")])
    assert all(r.probability is None for r in got)
    assert quality.quality(df.limit(0), labels.limit(0)).collect() == []
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
