"""Shared cases and fixtures of the corpus operators' tests."""

import pytest

SF = "/root/testdata/sf0.001"

#: Null id, null text, empty text, repeated rows, equal texts, one id twice
#: with different texts, blanks of all kinds, a very long text.
EDGE_ROWS = [(1, "one two three"), (1, "one two three"), (2, "one two three"), (3, None), (4, ""),
             (None, "no id"), (None, None), (5, "é " * 3 + "\t\x0b\n\n <|endoftext|> x  y \u00a0z"),
             (5, "another text with this id"), (6, "long word " * 30_000 + "z" * 50_000)]


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def frame(spark):
    """A table (doc_id, text, ...) with columns that clash with results."""
    def make(rows, more="n_tokens int, row string, k1 string, kept string, block string"):
        names = [c.split()[0] for c in more.split(", ")]
        kinds = {c.split()[0]: c.split()[1] for c in more.split(", ")}
        full = [(i, t, *(7 if kinds[n] == "int" else "x" for n in names)) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {more}")
    return make
