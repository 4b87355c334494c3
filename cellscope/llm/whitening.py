"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it: each
pass over the table applies the centred product XᵀX / n to a thin block Q, one
partial sum per task, added up by Spark. A filter step runs a polynomial
recurrence of such passes (Chebyshev polynomials of the first kind, scaled to the
unwanted part of the spectrum), which damps what lies in that part and leaves
the leading directions. QR and a Rayleigh-Ritz step then give eigenvalue and
eigenvector estimates with their residuals, until these certify the result.

What the driver holds is the model: a few blocks of (dimensions x ``BLOCK``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches, stored

#: Columns of the iterated block at least, and beyond the wanted components.
BLOCK, SPARE = 32, 8
#: Passes of one filter step, and steps after which the iteration gives up.
DEGREE, STEPS = 10, 60
#: Residuals, relative to the gap to the next eigenvalue, that certify a
#: component; the noise of double precision, relative to the first eigenvalue.
CERTIFIED, NOISE = 1e-12, 1e-14
#: Rows of a numpy step.
ROWS = 4096


class Model:
    """Number of fitted vectors, sums per dimension, components as columns,
    their eigenvalues, shares of the trace, and the residuals that certify them."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float,
                 residuals: np.ndarray, passes: int):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace
        self.residuals, self.passes = residuals, passes
        self.identity_error = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array of doubles) of the rows whose vector is not
    null and holds neither null nor a non-finite number."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e)
                                                             & (F.abs(e) < float("inf"))))


def scaled(batch: pa.RecordBatch, scale: int, offset: int, d: int) -> np.ndarray:
    """The integer vectors floor(scale * c) + offset of a batch."""
    c = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    wide = np.floor(c * scale)
    if len(wide) and np.abs(wide).max() >= 2.0**62:
        raise ValueError("an entry is too large for a 64-bit integer")
    return wide.astype(np.int64) + offset


def fit_list(rows: DataFrame, scale: int, offset: int, d: int) -> DataFrame:
    """Each distinct integer vector once (column x: its bytes). Repeats merge
    in the task before they are shuffled."""
    def work(batches):
        for batch in batches:
            x = scaled(batch, scale, offset, d)
            yield {"x": [row.tobytes() for row in x]}

    return stored(map_batches(rows.select("vector"), work, "x binary").distinct(), "vectors")


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            raw = b"".join(batch.slice(start, ROWS).column("x").to_pylist())
            yield np.frombuffer(raw, np.int64).reshape(-1, d)


def added(fit: DataFrame, d: int, partial, size: int) -> np.ndarray:
    """The sum over all fitted rows of ``partial(matrix)`` (``size`` numbers):
    one partial sum per task, added up by Spark."""
    def work(batches):
        total = None
        for x in matrices(batches, d):
            found = partial(x)
            total = found if total is None else total + found
        if total is not None:
            yield {"at": np.arange(size), "part": total}

    parts = map_batches(fit, work, "at long, part double").groupBy("at").agg(F.sum("part").alias("total"))
    out = np.zeros(size)
    for row in parts.collect():  # ``size`` rows
        out[row.at] = row.total
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def work(batches):
        n, total = 0, None
        for x in matrices(batches, d):
            found = x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 2**50 else x.sum(axis=0)
            n, total = n + len(x), found.astype(object) if total is None else total + found.astype(object)
        if n:
            yield {"at": np.arange(-1, d), "part": [str(n), *map(str, total)]}

    parts = (map_batches(fit, work, "at long, part string").groupBy("at")
             .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")))
    found = {r.at: int(r.total) for r in parts.collect()}  # d + 1 rows
    return found.get(-1, 0), [found.get(at, 0) for at in range(d)]


def chebyshev(apply, q: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of this degree in V, times ``q``, scaled so
    that it stays within 1 on [low, high]; columns are kept at unit length."""
    centre, radius = (high + low) / 2, max((high - low) / 2, 1e-300)
    before, now = q, (apply(q) - centre * q) / radius
    for _ in range(degree - 1):
        before, now = now, 2 / radius * (apply(now) - centre * now) - before
        size = np.linalg.norm(now, axis=0)
        size[size == 0] = 1
        before, now = before / size, now / size
    return now


def components(fit: DataFrame, d: int, k: int, seed: int = 1) -> Model | None:
    """The model of at most ``k`` components with an eigenvalue above noise;
    None without a fitted row."""
    n, sums = exact_sums(fit, d)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def partial(x):
            c = x - mean
            return (c.T @ (c @ q)).ravel()

        return added(fit, d, partial, q.size).reshape(q.shape) / n

    trace = float(added(fit, d, lambda x: ((x - mean) ** 2).sum(axis=0), d).sum() / n)
    k = min(k, d)
    block = min(d, max(BLOCK, k + SPARE))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    best = np.inf
    for _ in range(STEPS):
        vq = apply(q)
        values, turn = np.linalg.eigh(q.T @ vq)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = q @ turn
        residuals = np.linalg.norm(vq @ turn - ritz * values, axis=0)
        scale = max(values[0], 0.0)
        if scale <= 0:
            break
        # What a component's direction may be off by: its residual over the gap
        # to the next value. Equal values have no direction of their own.
        gaps = np.append(values[:-1] - values[1:], np.inf)
        gaps = np.minimum(gaps, np.append(np.inf, gaps[:-1]))
        worst = (residuals[:k] / np.maximum(gaps[:k], 1e-3 * scale)).max()
        if block == d or worst <= CERTIFIED or (residuals[:k].max() <= NOISE * 100 * scale and worst >= best / 2):
            break
        best = min(best, worst)
        # The unwanted part: from what the block says lies below it, to its last value.
        rest = (trace - values.sum()) / (d - block)
        low = max(0.0, min(rest - 3 * (values[-1] - rest), values[-1] * 0.5))
        q = np.linalg.qr(chebyshev(apply, ritz, low, values[-1], DEGREE))[0]
    else:
        raise ValueError(f"not certified after {STEPS} steps: residuals {residuals[:k]}")
    kept = [i for i in range(k) if values[i] > NOISE * 100 * max(trace, 1e-300) * d]
    model = Model(n, sums, ritz[:, kept], values[kept], trace, residuals[kept], passes)
    if kept:
        def moments(x):
            w = np.hstack([model.whitened(x), np.ones((len(x), 1))])
            return (w.T @ w).ravel()

        size = len(kept)
        both = added(fit, d, moments, (size + 1) ** 2).reshape(size + 1, size + 1) / n
        covariance = both[:size, :size] - np.outer(both[size, :size], both[size, :size])
        model.identity_error = float(np.abs(covariance - np.eye(size)).max())
    return model


def whiten(df: DataFrame, k: int = 4, scale: int = 256, offset: int = 0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per usable input row and component: vec_id, component, n,
    deviation, whitened, explained, identity_error, residual.

    Vectors become integers floor(scale * c) + offset; the model is fitted on
    each distinct integer vector once. Rows whose vector is null, or holds null
    or a non-finite number, are dropped; of vectors of several lengths only
    those of the most frequent one (of ties the longest) are kept, and vectors
    without entries are dropped. Repeated rows and null ids give rows each for
    itself. Components whose eigenvalue is zero (fewer directions than ``k``,
    one distinct vector) have no whitening and give no rows; so an empty table
    gives none. Equal eigenvalues have any orthonormal basis of their space, the
    same for all rows. A deviation beyond 64 bits fails the query. Other columns
    are not read.
    """
    spark = df.sparkSession
    shape = (f"vec_id {id_type(df, id_col)}, component int, n long, deviation long, whitened double, "
             "explained double, identity_error double, residual double")
    rows = usable(df, id_col, vector_col)
    length = (rows.groupBy(F.size("vector").alias("d")).count().where("d > 0")
              .orderBy(F.desc("count"), F.desc("d")).first())
    if length is None:
        return spark.createDataFrame([], shape)
    d = length.d
    rows = rows.where(F.size("vector") == d)
    model = components(fit_list(rows, scale, offset, d), d, k)
    found = len(model.values)
    explained = model.values / model.trace if found else model.values
    largest = max(map(abs, model.sums))

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                x = scaled(some, scale, offset, d)
                m = len(x)
                top = model.n * int(np.abs(x).max(initial=0)) + largest
                if top * top * d < 1 << 63:
                    far = ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1)
                else:
                    far = ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)
                at = np.repeat(np.arange(m), found)
                yield {"vec_id": some.column("vec_id").take(pa.array(at)),
                       "component": np.tile(np.arange(1, found + 1), m),
                       "n": np.full(m * found, model.n), "deviation": [int(v) for v in far[at]],
                       "whitened": model.whitened(x).ravel(), "explained": np.tile(explained, m),
                       "identity_error": np.full(m * found, model.identity_error),
                       "residual": np.tile(model.residuals, m)}

    return map_batches(rows, work, shape)
