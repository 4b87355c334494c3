"""Token counts without materialised ids.

Documents become frequencies of pre-tokens (matches of the split pattern).
The tokenizer counts the pieces of each distinct pre-token once; the counts
join back to the per-document frequencies and are summed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import id_type, map_batches
from .terms import blocks, one_by_one, per_document, summed
from .tokens import ChunkTable, special_tokens


@lru_cache(maxsize=2)
def worker_tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def pretokens(path: str, pattern: str):
    """(text, Terms) -> local numbers of the text's pre-tokens. A special
    string inside a text is a pre-token of its own."""
    import regex

    find = regex.compile(pattern).findall
    specials = list(special_tokens(path))

    def make():
        state: dict = {"terms": None, "table": None}

        def numbers(text: str, terms):
            if state["terms"] is not terms:
                state["terms"] = terms
                state["table"] = ChunkTable(
                    lambda chunk: [terms[piece.encode()] for piece in find(chunk)],
                    lambda parts: [n for part in parts for n in part], limit=1 << 62)
            for special in specials:
                if special in text:
                    out: list[int] = []
                    for at, part in enumerate(text.split(special)):
                        out += [terms[special.encode()]] * bool(at) + numbers(part, terms)
                    return out
            return state["table"](text)

        return numbers

    return make()


def token_counts(df: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than
    ``limit`` tokens).

    Null and empty texts have no bytes and no tokens. Repeated rows and null
    ids give a row each; other columns are not read.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = blocks(df, lambda: one_by_one(pretokens(tokenizer_path, pattern)), buckets, id_col, text_col,
                   name="pretokens")

    def count(batches):
        tokenizer = worker_tokenizer(tokenizer_path)
        known: dict[bytes, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                rows = batch.slice(start, 16)
                terms = rows.column("terms").to_pylist()
                new = list({t for row in terms for t in row if t not in known})
                if len(known) + len(new) > 1_000_000:
                    known.clear()
                    new = list({t for row in terms for t in row})
                for at in range(0, len(new), 4096):
                    some = new[at:at + 4096]
                    found = tokenizer.encode_batch_fast([t.decode() for t in some], add_special_tokens=False)
                    known.update(zip(some, map(len, found)))
                yield {"block": rows.column("block"), "bucket": rows.column("bucket"),
                       "values": [[known[t] for t in row] for row in terms]}

    # All rows of a bucket meet in one partition, so a pre-token is counted once.
    values = map_batches(
        table.where("bucket IS NOT NULL").select("block", "bucket", "terms").repartition(buckets, "bucket"),
        count, "block long, bucket int, values array<int>")

    def combine(row, values, per_doc, numbers, counts):
        tokens = summed(per_doc, values.astype(np.int64)[numbers] * counts)
        return {"doc_id": row["doc_ids"], "n_bytes": row["sizes"], "n_tokens": tokens,
                "over_limit": tokens > limit}

    return per_document(table, values, combine,
                        f"doc_id {id_type(df, id_col)}, n_bytes long, n_tokens long, over_limit boolean")
