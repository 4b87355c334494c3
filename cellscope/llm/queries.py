"""One registered query per operator, with production parameters, over whole
tables. The queries derive digest columns from the operators' real outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, ctw, exact, jaccard, lines, packing, phrases, quality, repeats, simhash, urls, whitening

Query = Callable[[SparkSession, str], DataFrame]

#: Host and path prefix, and what becomes of the URLs it fits.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"),
             ("example.com/de/", "block"), ("org/fr/", "allow"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, passage=250)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                        "n_passage")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), folds=7, held_fold=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4, scale=256).drop("residual")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=4, min_count=30, share=80, top=2000)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_bpe, op3_url_filter, op4_packing, op5_context_tree, op6_quality,
    op7_simhash, op8_line_dedup, op9_token_counts, op10_exact_dedup, op11_jaccard_join, op12_whitening, op13_collocations)}

ORACLE_SQL: dict[str, str] = {
    # Every byte position's string, in hexadecimal digits, by its hash; first the
    # 400-byte strings, then what 250-byte strings cover.
    "op1_suffix_array_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT len, r, p, md5(substr(h, 2 * p + 1, 2 * len)) AS m
  FROM (SELECT len, r, h, unnest(range(0, greatest(length(h) // 2 - len + 1, 0))) AS p
        FROM d, (SELECT unnest([400, 250]) AS len))
), repeated AS (
  SELECT len, r, p FROM (SELECT len, r, p, count(*) OVER (PARTITION BY len, m) AS n FROM g) WHERE n > 1
), opened AS (
  SELECT len, r, p, CASE WHEN p - lag(p) OVER (PARTITION BY len, r ORDER BY p) <= len THEN 0 ELSE 1 END AS o
  FROM repeated
), spans AS (
  SELECT len, r, s, min(p) AS a, max(p) + len AS b
  FROM (SELECT len, r, p, sum(o) OVER (PARTITION BY len, r ORDER BY p) AS s FROM opened) GROUP BY len, r, s
), passages AS (
  SELECT r, CAST(sum(b - a) AS BIGINT) AS n_passage FROM spans WHERE len = 250 GROUP BY r
), kept AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM (SELECT spans.*, d.h, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before
        FROM spans JOIN d USING (r) WHERE len = 400) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(n_passage, 0) AS n_passage,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN passages USING (r)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # Every contiguous phrase of one to four words, listed and counted.
    "op13_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), placed AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded
), grams AS (
  SELECT lang, ws[i:i + m] AS g FROM placed, (SELECT unnest([0, 1, 2, 3]) AS m) WHERE i + m <= len(ws)
), f AS (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang
), candidates AS (
  SELECT lang, g, f AS a FROM f WHERE f >= 30 AND len(g) > 1
), cuts AS (
  SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r,
         (CAST(2000000 AS HUGEINT) * c.a) // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k]
  JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a, g[i:i + m] AS part
  FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 1)) AS i
        FROM candidates, (SELECT unnest([1, 2]) AS m) WHERE m + 1 < len(g))
), covered AS (
  SELECT lang, part, max(a) AS longer FROM parts GROUP BY ALL
), ranked AS (
  SELECT lowest.*, array_to_string(lowest.g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lowest.lang
                            ORDER BY score DESC, lowest.a DESC, array_to_string(lowest.g, ' ')) AS rank
  FROM lowest LEFT JOIN covered ON covered.lang = lowest.lang AND covered.part = lowest.g
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * lowest.a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
