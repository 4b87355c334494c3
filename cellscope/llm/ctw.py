"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, those of its bits from the top; the decision
after a given prefix of bits is a node. Each node of each context keeps how
often 0 and 1 came (Krichevsky-Trofimov estimate), and a node's weighted
probability mixes its own estimate with that of its longer contexts, half and
half, over all depths. After training, the mixture that the tree holds for a
context is one number per byte: the table of code lengths that texts are scored
with.

Contexts are whole bytes, up to ``bytetree.DEPTH`` of them (the order of the
model); the counts of the tree lie in Spark tables that grow with the corpus, see
``bytetree``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetree import RANGE_GRAMS, SAMPLED, pack
from .bytetree import scores as bytetree_scores
from .common import id_type, stored, sweep
from .terms import Terms, blocks, per_document, summed


def lowered(text: str) -> bytes:
    return text.encode().lower()


def training(ids: list, folds: int, held_fold: int) -> np.ndarray:
    """Whether crc32 of the id as text is in another than the held-out fold."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % folds != held_fold for i in ids], bool)


END = b""  # the end of a text, a token that no word equals


def word_numbers(texts: list[str], terms: Terms) -> list[np.ndarray]:
    """Local numbers of each text's tokens: its lower-cased words, then the end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    per_text = pc.list_value_length(split).to_numpy()
    found = split.flatten().dictionary_encode()
    known = np.array([terms[w] for w in found.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)
    numbers, end = known[found.indices.to_numpy()], terms[END]
    # White space at a text's ends leaves empty strings, which are no words.
    return [np.append(own[own != end], end) for own in np.split(numbers, np.cumsum(per_text)[:-1])]


def score(df: DataFrame, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id",
          text_col: str = "text", range_grams: int = RANGE_GRAMS, sampled: int = SAMPLED) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte.

    Texts are lower-cased (A-Z). ``score`` is the tree's log10 probability of
    the text's bytes, ``bits_per_byte`` its code length. The base is a unigram
    model over words and one end per text, add-one smoothed over the training
    tokens. Training texts are those whose id, as text, has another crc32
    remainder than ``held_fold``. Null and empty texts: one token (the end),
    score 0, no bits per byte. A null id counts as the empty text. Repeated rows
    train and score each for itself. Without training texts every token is
    unknown and every byte costs eight bits. An empty table gives no rows; texts
    without a byte make no tree. Other columns are not read. ``range_grams`` and
    ``sampled`` say into what pieces the work is cut, not what comes out.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    table = blocks(df, lambda: word_numbers, buckets, id_col, text_col,
                   train=lambda ids, texts: training(ids, folds, held_fold),
                   packed=lambda texts: pack([lowered(t) for t in texts]), name="words")
    found = bytetree_scores(table.where("bucket IS NULL").select("block", "doc_ids", "sizes", "packed"),
                            lambda ids: training(ids, folds, held_fold), buckets, range_grams, sampled)
    vocabulary = (table.where("bucket IS NOT NULL")
                  .select("block", "bucket", F.posexplode(F.arrays_zip("terms", "train_counts")).alias("at", "t"))
                  .select("block", "bucket", "at", "t.terms", "t.train_counts"))
    counts = stored(vocabulary.groupBy("terms").agg(F.sum("train_counts").alias("c")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                        F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = int(totals.n), int(totals.v)
    sweep(spark)  # of what only the tree and the counts have shuffled
    values = (vocabulary.select("block", "bucket", "at", "terms").join(counts, "terms")
              .select("block", "bucket", "at", F.col("c").alias("value")))

    def combine(row, values, per_doc, numbers, freq):
        known = values[numbers]
        logs = np.log10(known + 1.0) - np.log10(n + v + 1.0)
        scores, sizes = np.array(row["measures"]), row["sizes"]
        return {"doc_id": row["doc_ids"], "held_out": ~training(row["doc_ids"], folds, held_fold),
                "n_tokens": summed(per_doc, freq), "n_known": summed(per_doc, freq * (known > 0)),
                "train_tokens": np.full(len(sizes), n), "base_score": summed(per_doc, logs * freq),
                "score": scores, "n_bytes": sizes,
                "bits_per_byte": [float(-s / np.log10(2) / b) if b else None for s, b in zip(scores, sizes)]}

    heads = table.where("bucket IS NULL").drop("packed").join(found, F.col("block") == F.col("scored")).drop("scored")
    return per_document(heads, values, combine,
                        f"doc_id {id_type(df, id_col)}, held_out boolean, n_tokens long, n_known long, "
                        "train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
