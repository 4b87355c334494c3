"""URL filtering: explicit rules first, a character language-model ratio for
the rest.

Two variable-order Markov models, one of accepted and one of rejected URLs,
give each next character a probability smoothed over all shorter contexts
(Witten-Bell). A URL's score is the difference of both log-likelihoods per
character; the threshold is calibrated on labelled URLs that were not used for
the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches

#: Labelled URLs of each verdict that the models are fitted and calibrated on,
#: those with the smallest hashes; the documented bound of the fit.
FIT_URLS = 4000
#: Longest context in characters.
ORDER = 4
#: One labelled URL in so many is kept for the calibration.
HOLD_OUT = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    in lower case; path: from there up to ``?``, ``#`` or the end. Null or no
    ``://``: both empty."""
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER), F.regexp_extract(whole, PARTS, 2)


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule (host followed by path) that fits, as (rule, verdict);
    null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = (((host == name) | F.endswith(host, F.lit("." + name)))
                & F.startswith(path, F.lit(slash + rest)))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class MarkovModel:
    """Counts of (context, next character) for all contexts up to ``order``."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int, alphabet: int):
        self.order, self.floor = order, 1.0 / max(1, alphabet)
        self.seen = {context: (sum(after.values()), len(after), after)
                     for context, after in counts.items()}

    def log2(self, text: str) -> float:
        total, seen = 0.0, self.seen
        padded = "\x02" * self.order + text + "\x03"
        for at in range(self.order, len(padded)):
            char, p = padded[at], self.floor
            for length in range(self.order + 1):
                known = seen.get(padded[at - length:at])
                if known is None:
                    break
                count, kinds, after = known
                p = (after.get(char, 0) + kinds * p) / (count + kinds)
            total += math.log2(p)
        return total


def spelled(url: str) -> str:
    """What the models read: the URL without scheme, digits all alike."""
    rest = url.split("://", 1)[-1].lower()
    return "".join("0" if c.isdigit() else c for c in rest)


def score(models: tuple[MarkovModel, MarkovModel], url: str) -> float:
    """Log-likelihood difference, accepted less rejected, in bits per character."""
    text = spelled(url)
    return (models[0].log2(text) - models[1].log2(text)) / (len(text) + 1)


def calibrated(accepted: list[float], rejected: list[float]) -> float:
    """The threshold with the least mean of both error rates; of equal ones
    the midpoint nearest to zero."""
    if not accepted or not rejected:
        return 0.0
    cuts = sorted({*accepted, *rejected})
    middles = [cuts[0] - 1e-9, *((a + b) / 2 for a, b in zip(cuts, cuts[1:])), cuts[-1] + 1e-9]
    good, bad = sorted(accepted), sorted(rejected)
    best, i, j = [], 0, 0
    for t in middles:
        while i < len(good) and good[i] < t:
            i += 1
        while j < len(bad) and bad[j] < t:
            j += 1
        best.append((i / len(good) + (len(bad) - j) / len(bad), abs(t), t))
    return min(best)[2]


def fit(labelled: DataFrame, order: int = ORDER, fit_urls: int = FIT_URLS):
    """(models, threshold) from columns url and verdict. Spark counts the
    contexts; only the counts of at most ``2 * fit_urls`` URLs reach the driver."""
    picked = None
    for verdict in ("allow", "block"):
        some = (labelled.where((F.col("verdict") == verdict) & F.col("url").isNotNull())
                .select("url", "verdict").distinct()
                .orderBy(F.xxhash64("url"), "url").limit(fit_urls))
        picked = some if picked is None else picked.unionAll(some)
    picked = picked.withColumn("held", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(HOLD_OUT)) == 0)

    def contexts(batches):
        from collections import Counter
        counts: Counter = Counter()
        for batch in batches:
            for url, verdict, held in zip(*(batch.column(c).to_pylist() for c in ("url", "verdict", "held"))):
                if held:
                    continue
                padded = "\x02" * order + spelled(url) + "\x03"
                for at in range(order, len(padded)):
                    for length in range(order + 1):
                        counts[verdict, padded[at - length:at], padded[at]] += 1
        if counts:
            verdicts, before, chars = zip(*counts)
            yield {"verdict": verdicts, "context": before, "char": chars, "n": list(counts.values())}

    counted = (map_batches(picked, contexts, "verdict string, context string, char string, n long")
               .groupBy("verdict", "context", "char").agg(F.sum("n").alias("n")).collect())
    tables: dict[str, dict[str, dict[str, int]]] = {"allow": {}, "block": {}}
    for row in counted:
        tables[row.verdict].setdefault(row.context, {})[row.char] = row.n
    alphabet = len({row.char for row in counted}) + 1
    models = (MarkovModel(tables["allow"], order, alphabet), MarkovModel(tables["block"], order, alphabet))
    held = [(r.verdict, score(models, r.url)) for r in picked.where("held").select("verdict", "url").collect()]
    return models, calibrated([s for v, s in held if v == "allow"], [s for v, s in held if v == "block"])


def url_filter(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", order: int = ORDER, fit_urls: int = FIT_URLS) -> DataFrame:
    """One row per input row: the id as ``page_id``, host, path, rule, verdict,
    score (bits per character; null where a rule decides).

    ``rules`` are (rule, 'allow' or 'block') with a rule like ``net/``. The
    models learn from the URLs that rules decide. Null and empty URLs have
    empty host and path; their score is that of the end symbol, which both models
    have learned after the URLs' last characters. With no labelled URLs of either
    kind every score and the threshold are 0, which allows. Repeated rows and null ids give
    a row each; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    base = (df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
            .withColumn("host", host).withColumn("path", path)
            .withColumn("found", matching_rule(F.col("host"), F.col("path"), tuple(rules)))
            .select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"),
                    F.col("found.verdict").alias("verdict")))
    models, threshold = fit(base, order, fit_urls)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def judge(batches):
        own = shared.value
        for batch in batches:
            urls, verdicts = batch.column("url").to_pylist(), batch.column("verdict").to_pylist()
            scores = [None if v else score(own, u or "") for u, v in zip(urls, verdicts)]
            yield {c: batch.column(c) for c in ("page_id", "host", "path", "rule")} | {
                "verdict": [v or ("allow" if s >= threshold else "block") for v, s in zip(verdicts, scores)],
                "score": scores}

    return map_batches(base, judge, f"page_id {id_type(df, id_col)}, host string, path string, "
                                    "rule string, verdict string, score double")
