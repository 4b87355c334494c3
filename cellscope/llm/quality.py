"""Quality rules: plain text statistics, then a calibrated logistic regression
over hashed word and character n-grams.

The classifier is fitted on a bounded sample of labelled rows
(``FIT_ROWS`` per label) and calibrated on a held-out part; every row is scored
in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches, ship, slices, two_columns

#: Labelled rows of each label that the classifier is fitted on, those whose
#: ids have the smallest hashes; the documented bound of the fit.
FIT_ROWS = 1000
#: One labelled row in so many is kept for the calibration.
HOLD_OUT = 4
#: Hash buckets of word n-grams and of character n-grams.
WORD_BUCKETS, CHAR_BUCKETS = 2048, 2048
#: Fixed thresholds: fewest words, largest share of repeated words in percent,
#: least calibrated probability of good quality.
MIN_WORDS, MAX_REPEATED_PERCENT, MIN_PROBABILITY = 50, 50, 0.3

SYMBOLS = re.compile(rb"[#*$%&|<>]")


class WordBuckets(dict):
    """Bucket of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word) % WORD_BUCKETS
        if len(self) >= 500_000:
            self.clear()
        self[word] = bucket
        return bucket


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first one
    included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
    window = pair[:-1] * len(ids) + code[2:]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    cover = np.zeros(n, bool)
    for shift in range(3):
        cover[shift:n - 2 + shift] |= again
    return int(cover.sum())


def statistics(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = Counter(line for line in raw.split(b"\n") if line.strip(b"\x20\x09\x0a\x0b\x0c\x0d"))
    joined = b"".join(words)
    return (len(words), len(joined.decode()), len(SYMBOLS.findall(raw)),
            sum(lines.values()) - len(lines), repeated_words(words))


def features(raw: bytes, words: list[bytes], buckets: WordBuckets) -> np.ndarray:
    """Square roots of the shares of hashed words and word pairs, and of
    hashed character 4-grams."""
    out = np.zeros(WORD_BUCKETS + CHAR_BUCKETS, np.float32)
    if words:
        code = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
        pairs = (code[:-1] * 31 + code[1:] * 17 + 7) % WORD_BUCKETS
        found = np.bincount(code, minlength=WORD_BUCKETS) + np.bincount(pairs, minlength=WORD_BUCKETS)
        out[:WORD_BUCKETS] = np.sqrt(found / (len(code) + len(pairs)))
    data = np.frombuffer(raw, np.uint8)
    if len(data) >= 4:
        gram = data[:-3].astype(np.uint32)
        for shift in range(1, 4):
            gram = gram << np.uint32(8) | data[shift:len(data) - 3 + shift]
        code = (gram * np.uint32(2654435761)) >> np.uint32(21)
        out[WORD_BUCKETS:] = np.sqrt(np.bincount(code, minlength=CHAR_BUCKETS) / len(gram))
    return out


@dataclass
class Classifier:
    """Logistic regression and its calibration (Platt)."""
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> float:
        raw = float(x @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -60, 60))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, ridge: float = 1e-4, steps: int = 400) -> Classifier:
    """Accelerated gradient descent on the rows not held out, both labels with
    equal weight; slope and shift fitted on the held-out rows."""
    def balance(labels):
        share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        return share / share.sum()

    a, b = x[~held], y[~held]
    mean = a.mean(0)
    a = a - mean
    share = balance(b)
    w, v, bias, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    rate = 4.0 / max(1e-9, float((share[:, None] * a * a).sum()) + 1)
    for step in range(steps):
        error = share * (sigmoid(a @ v + vb) - b)
        new, new_bias = v - rate * (a.T @ error + ridge * v), vb - rate * error.sum()
        pull = step / (step + 3)
        v, vb, w, bias = new + pull * (new - w), new_bias + pull * (new_bias - bias), new, new_bias
    bias -= float(mean @ w)
    slope, shift = 1.0, 0.0
    if held.any() and len(set(y[held])) == 2:
        z, t = x[held] @ w + bias, y[held]
        spread = max(float(z.std()), 1e-9)
        share, z = balance(t), z / spread
        # Smoothed targets keep the fit finite when both labels separate.
        good, bad = (t == 1).sum(), (t == 0).sum()
        goal = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        for _ in range(50):
            p = sigmoid(slope * z + shift)
            g = np.array([(share * (p - goal) * z).sum(), (share * (p - goal)).sum()])
            curve = share * p * (1 - p)
            h = np.array([[(curve * z * z).sum(), (curve * z).sum()], [(curve * z).sum(), curve.sum()]])
            move = np.linalg.solve(h + 1e-6 * np.eye(2), g)
            slope, shift = slope - move[0], shift - move[1]
        slope /= spread
    return Classifier(w.astype(np.float32), float(bias), float(slope), float(shift))


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str,
        fit_rows: int = FIT_ROWS) -> Classifier | None:
    """The classifier, or None when a label has no rows. At most
    ``2 * fit_rows`` ids are broadcast and as many feature rows collected: of
    several rows with one id the text of least hash is fitted, however many they
    are."""
    chosen = None
    known = (labels.select(F.col(label_id).alias("label_id"), F.col(label_col).cast("int").alias("label"))
             .where("label_id IS NOT NULL AND label IN (0, 1)").groupBy("label_id").agg(F.max("label").alias("label")))
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
        chosen = some if chosen is None else chosen.unionAll(some)
    texts = two_columns(df, id_col, text_col)
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))  # merges before it is shuffled
    rows = (texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
            .groupBy("label_id", "label").agg(least.alias("least")).select(
                "label", (F.pmod(F.xxhash64(F.lit("fold"), "label_id"), F.lit(HOLD_OUT)) == 0).alias("held"),
                F.col("least.text").alias("text")))

    def vectors(batches):
        buckets = WordBuckets()
        for batch in slices(batches, 500):
            found = []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                found.append(features(raw, raw.split(), buckets).astype(np.float16).tobytes())
            yield {"label": batch.column("label"), "held": batch.column("held"), "x": found}

    found = map_batches(rows, vectors, "label int, held boolean, x binary").toArrow().to_pydict()
    if len(set(found["label"])) < 2:
        return None
    order = sorted(range(len(found["x"])), key=lambda i: (found["x"][i], found["label"][i]))
    x = np.stack([np.frombuffer(found["x"][i], np.float16).astype(np.float32) for i in order])
    y, held = (np.array([found[c][i] for i in order]) for c in ("label", "held"))
    if len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    return train(x, y, held)


def judge_columns(raw: bytes, words: list[bytes], model: Classifier | None, buckets: WordBuckets,
                  min_words: int, max_repeated_percent: int, min_probability: float) -> tuple:
    """The statistics, base_failed, probability and kept of one text."""
    stats = statistics(raw, words)
    failed = stats[0] < min_words or 100 * stats[4] > max_repeated_percent * stats[0]
    probability = None if model is None else model.probability(features(raw, words, buckets))
    return *stats, failed, probability, not failed and (probability is None or probability >= min_probability)


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
       "probability", "kept")


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_id: str = "doc_id", label_col: str = "quality", min_words: int = MIN_WORDS,
            max_repeated_percent: int = MAX_REPEATED_PERCENT, min_probability: float = MIN_PROBABILITY,
            fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, probability, kept.

    Words are runs of bytes other than space and 09-0D. Null and empty texts
    have no words and fail the base rules. Without labelled rows of both labels
    the probability is null and the base rules decide alone. Labels with a null
    id or value are left out; of repeated ones the better label counts. Repeated
    rows and null ids give a row each; other columns are not read.
    """
    model = fit(df, labels, id_col, text_col, label_id, label_col, fit_rows)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        buckets = WordBuckets()
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                rows.append(judge_columns(raw, raw.split(), shared.value, buckets, min_words,
                                          max_repeated_percent, min_probability))
            yield {"doc_id": batch.column("doc_id")} | dict(zip(OUT, map(list, zip(*rows))))

    return map_batches(
        two_columns(df, id_col, text_col), judge,
        f"doc_id {id_type(df, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_id: str = "doc_id", label_col: str = "quality", min_words: int = MIN_WORDS,
              max_repeated_percent: int = MAX_REPEATED_PERCENT, min_probability: float = MIN_PROBABILITY,
              fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``df`` that ``quality`` keeps, all columns unchanged. The
    verdict is made in place, so nothing is joined or shuffled."""
    model = fit(df, labels, id_col, text_col, label_id, label_col, fit_rows)
    shared = df.sparkSession.sparkContext.broadcast(model)
    ship(df.sparkSession)

    def judge(batches):
        buckets = WordBuckets()
        for batch in batches:
            kept = []
            for text in batch.column(text_col).to_pylist():
                raw = (text or "").encode()
                kept.append(judge_columns(raw, raw.split(), shared.value, buckets, min_words,
                                          max_repeated_percent, min_probability)[-1])
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(judge, df.schema)
