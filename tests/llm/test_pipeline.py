"""The pipeline's stages against brute force, each on its own input."""

import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cellscope.llm import quality
from llm_cases import EDGE_ROWS, SF
from test_corpus_operators import JSON, brute_components, brute_fingerprint, brute_long, lines_alike

ROOT = Path(__file__).resolve().parents[2]
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of each stage, every stage run on what the one
    before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        found[name] = (docs.collect(), out.collect(), out.columns)
        docs = out
    return found


def by_id(rows):
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_dedup", "repeated_passages", "packing"]
    assert all(stages[n][2] == COLUMNS for n, _ in corpus_pipeline.STAGES[:-1])


def test_quality_stage(spark, stages):
    before, after, _ = stages["quality_rules"]
    verdicts = quality.quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in verdicts.where("kept").collect()}
    assert {tuple(r) for r in after} == {tuple(r) for r in before if r.doc_id in kept}
    assert 0 < len(after) < len(before)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    long_good = [r.doc_id for r in before if r.doc_id in good and len(r.text.split()) >= 50]
    assert sum(i in kept for i in long_good) >= 0.95 * len(long_good)


def test_line_stage(stages):
    before, after, _ = stages["line_dedup"]
    seen, by_size, want = set(), defaultdict(list), {}
    for r in sorted(before, key=lambda r: r.doc_id):
        left = []
        for line in r.text.split("\n"):
            words = tuple(line.encode().split())
            size = len(words) if len(words) >= 10 else -len(b" ".join(words).decode()) - 10
            alike = words in seen or any(lines_alike(list(words), list(v), 10)
                                         for n in (-1, 0, 1) for v in by_size[size + n])
            if not words or not alike:
                left.append(line)
            if words and words not in seen:
                seen.add(words)
                by_size[size].append(words)
        want[r.doc_id] = "\n".join(left)
    got = by_id(after)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in after)
    assert any(len(want[r.doc_id]) < len(r.text) for r in before)


def test_simhash_stage(stages):
    before, after, _ = stages["simhash_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    group = brute_components([brute_fingerprint(r.text) for r in rows])
    assert {tuple(r) for r in after} == {tuple(rows[g]) for g in set(group)}


def test_repeats_stage(stages):
    before, after, _ = stages["repeated_passages"]
    brute = brute_long([(r.doc_id, r.text) for r in before], corpus_pipeline.PASSAGE)
    want = {r.doc_id: w[3].decode(errors="ignore") for r, w in zip(before, brute)}
    want = {r.doc_id: want[r.doc_id] for r in before if want[r.doc_id].split() or not r.text.split()}
    assert {i: r.text for i, r in by_id(after).items()} == want


def test_passages_of_fifty_words_go_and_other_words_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (51, 55, 60)]
    # Around a passage every text goes on with a letter of its own.
    own = {i: [f"{' '.join(word() for _ in range(40))} {chr(65 + i)}",
               f"{chr(65 + i)} {' '.join(word() for _ in range(40))}"] for i in range(12)}
    rows = [(i, f"{a} {passages[i % 3]} {b}" if i < 9 else f"{a} {b}") for i, (a, b) in own.items()]
    rows += [(20, passages[0]), (21, ""), (22, None), (23, "  ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert set(got) == {i for i, _ in rows} - {20}  # of 20 no word is left
    for i, (a, b) in own.items():
        assert not any(p in got[i].text for p in passages) and a in got[i].text and b in got[i].text
        assert got[i].n_chars == len(got[i].text)
    assert (got[21].text, got[22].text, got[23].text) == ("", None, "  ")


def test_packing_stage(stages):
    before, after, columns = stages["packing"]
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(columns)
    library = Tokenizer.from_file(JSON)
    sizes = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    total = Counter()
    for r in after:
        assert r.doc_tokens == sizes[r.doc_id]
        total[r.doc_id] += r.length
    assert total == sizes


def test_run_is_the_chain_of_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.doc_tokens) for r in got.collect() if r.start == 0) == \
        Counter((r.doc_id, r.doc_tokens) for r in stages["packing"][1] if r.start == 0)


def test_stages_on_odd_and_empty_tables(spark):
    full = [(i, t, "en" if k % 2 else None, None, None, 7) for k, (i, t) in enumerate(EDGE_ROWS)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert (out.columns == COLUMNS) == (name != "packing")
        assert out.count() <= len(EDGE_ROWS) or name == "packing"
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_entry_without_the_corpus_operators(tmp_path):
    """The driver deletes the subpackage, its tests and the pipeline."""
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("__spark_entry__.py", "cellscope"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(copy)], check=True)
    code = (
        "import importlib.abc, sys\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'cellscope.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op1') or n == 'pipeline' for n in e.queries())\n"
        "assert len(e.queries()) == len(e.oracle_sql()) > 20\n")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
