"""What SQL can say of the queries that have no whole oracle: host, path and
rule of URLs, the base statistics of the quality rules, byte counts, components
of given fingerprints."""

import duckdb
import pytest

from cellscope.llm import queries
from llm_cases import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def matches(got, rel):
    assert sorted(tuple(r) for r in got.select(*rel.columns).collect()) == sorted(rel.fetchall())


def test_hosts_paths_and_rules(spark, duck):
    rules = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in queries.URL_RULES)
    rel = duck.sql(f"""
WITH rules AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
  FROM (VALUES {rules}) t(rule, verdict)
), after AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages
), hosts AS (
  SELECT page_id, a, regexp_extract(a, '^[^/?#]*') AS h FROM after
), parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(a, length(h) + 1), '^[^?#]*') AS path
  FROM hosts
)
SELECT parts.*, (SELECT arg_max(rule, length(rule)) FROM rules
                 WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule
FROM parts""")
    got = queries.op3_url_filter(spark, SF)
    key = lambda r: tuple((v is None, v or "") for v in r)
    assert sorted((tuple(r) for r in got.select(*rel.columns).collect()), key=lambda r: (r[0], key(r[1:]))) == \
        sorted(rel.fetchall(), key=lambda r: (r[0], key(r[1:])))


def test_quality_statistics(spark, duck):
    matches(queries.op6_quality(spark, SF), duck.sql(r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 2]) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), stats AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats"""))


def test_byte_counts(spark, duck):
    matches(queries.op9_token_counts(spark, SF),
            duck.sql("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"))


def test_components_of_given_fingerprints(spark, duck):
    found = queries.op7_simhash(spark, SF)
    duck.register("prints", found.toArrow())
    matches(found, duck.sql("""
WITH RECURSIVE bits AS (
  SELECT doc_id, fingerprint, CAST('0x' || fingerprint AS UBIGINT) AS fp FROM prints
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM bits a, bits b WHERE bit_count(xor(a.fp, b.fp)) <= 2
), reached AS (
  SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT doc_id, fingerprint, least AS component_id
FROM prints JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) ON doc_id = a"""))
