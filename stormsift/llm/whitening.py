"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor, projected vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.llm.common import table

SCALE, SHIFT = 64, 1_000_000
#: Components at most, and vectors that a task holds as a matrix of doubles at once.
COMPONENTS, ROWS = 32, 4096
#: A pivot below this share of the largest variance is rounding: the factor ends, and with it the components.
RANK = 1e-12
_LONG = 1 << 63


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of rows whose vector is neither null nor holds null or non-finite entries."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.forall("vector", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))))


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows and their x as whole doubles (exact below 2^53), a row for each vector."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.floor(SCALE * part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) + SHIFT


def summed(vectors: DataFrame, d: int, gain: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], float]:
    """Sums of gain(x) over all vectors, an array of at most d by d whose size does not follow the rows.

    Each task adds up its own and sends one number for each cell that is not zero; cells are summed by Spark. Whole
    numbers below 2^53 are summed exactly, whatever the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, d):
            total = gain(x) if total is None else total + gain(x)
        if total is not None:
            i, j = np.nonzero(total)
            yield pa.record_batch({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(total[i, j])})

    cells = vectors.select("vector").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in cells.collect()}  # at most d by d numbers


def pivoted_cholesky(v: np.ndarray, least: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(order, lower triangle of d by rank) with v[order][:, order] = lower @ lower.T up to what is below least."""
    a, d = v.astype(float).copy(), len(v)
    order, low = np.arange(d), np.zeros((d, d))
    floor = least * max(float(np.max(np.diag(a), initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if not a[p, p] > floor:
            return order, low[:, :k]
        for m in (a, low):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return order, low


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """factor with its columns rotated in pairs until all are orthogonal; factor @ factor.T stays the same.

    A sweep meets all pairs in rounds of disjoint pairs (the circle of a tournament), so that a round is one array step.
    """
    g = factor.copy()
    r = g.shape[1]
    seats = np.arange(r + r % 2)  # an odd number of columns leaves one out in each round
    for _ in range(sweeps):
        moved = False
        for _ in range(max(1, len(seats) - 1)):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = np.maximum(p, q) < r
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            turn = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if turn.any():
                moved = True
                p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
                cos = 1 / np.sqrt(1 + t * t)
                sin = cos * t
                g[:, p], g[:, q] = cos * g[:, p] - sin * g[:, q], sin * g[:, p] + cos * g[:, q]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not moved:
            break
    return g


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit components as rows) of a symmetric matrix v without negative eigenvalues."""
    order, low = pivoted_cholesky(v)
    factor = np.zeros_like(low)
    factor[order] = low
    g = one_sided_jacobi(factor)
    size = (g**2).sum(0)
    by = np.argsort(-size, kind="stable")[:most]
    by = by[size[by] > 0]
    return size[by], (g[:, by] / np.sqrt(size[by])).T


@dataclass
class Whitening:
    """What the tasks need: sums of x, a whole number near each mean, what the mean has besides it, and the components."""

    n: int
    sums: list[int]
    near: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near - self.rest) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null where it does not fit a long."""
        off = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)], object)
        y = x - self.near
        most = self.n * float(np.abs(y).max(initial=0)) + max((abs(o) for o in off), default=0)
        if most * most * len(off) < _LONG / 4 and most < 2**53:
            z = self.n * y.astype(np.int64) - off.astype(np.int64)
            return (z * z).sum(1).tolist()
        whole = [sum((self.n * int(a) - o) ** 2 for a, o in zip(row, off, strict=True)) for row in y]
        return [s if s < _LONG else None for s in whole]


def fitted(vectors: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """Two passes: counts and sums, then the scatter around whole numbers next to the means, exact as long as its sums stay
    below 2^53. What the means have besides these is taken off as integers, before the one division."""
    first = summed(vectors, d, lambda x: np.vstack([np.full(d, float(len(x))), (x - SHIFT).sum(0)]))
    n = int(first.get((0, 0), 0))
    sums = [int(first.get((1, j), 0.0)) + n * SHIFT for j in range(d)]
    near = [(2 * s + n) // (2 * n) for s in sums]
    center = np.array(near, float)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = x - center
        return y.T @ y

    cells = summed(vectors, d, scatter)
    off = [s - n * m for s, m in zip(sums, near, strict=True)]
    v = np.array([[(n * int(cells.get((i, j), 0.0)) - off[i] * off[j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)
    values, rows = principal((v + v.T) / 2, most)
    return Whitening(n, sums, center, np.array([o / n for o in off]), rows, values, float(np.trace(v)))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and component.

    Four passes over the table: sums, scatter, the covariance of the whitened vectors (identity_error), the result. What
    goes through the driver are sums by dimension, d by d numbers at most; rotations run there on that matrix alone.

    Rows whose vector is null, or holds null or non-finite entries, take no part. Vectors should have one length; if they
    do not, those of the most frequent length take part (of equally frequent ones, the longest), empty ones never.
    Directions without variance have no component (their pivot is below RANK of the largest variance), so equal vectors or a
    single one give no rows, as does an empty table. Repeated rows and ids count and stand as often as they do; null ids
    stay; other columns are not read.
    """
    spark, every = embeddings.sparkSession, usable(embeddings).where(F.size("vector") > 0)
    length = every.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if length is None:
        return spark.createDataFrame([], OUT)
    d = length["d"]
    vectors = every.where(F.size("vector") == d)
    w = fitted(vectors, d, most)
    k = len(w.eigenvalues)
    if not k:
        return spark.createDataFrame([], OUT)

    def spread(x: np.ndarray) -> np.ndarray:
        y = w.project(x)
        return np.vstack([y.sum(0), y.T @ y])

    cells = summed(vectors, d, spread)
    mean = np.array([cells.get((0, j), 0.0) / w.n for j in range(k)])
    second = np.array([[cells.get((i + 1, j), 0.0) / w.n for j in range(k)] for i in range(k)])
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    share = w.eigenvalues / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, d):
            m = len(x)
            yield pa.record_batch(
                {
                    "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, w.n)),
                    "deviation": pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": pa.array(w.project(x).reshape(-1)),
                    "explained": pa.array(np.tile(share, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
            )

    return vectors.mapInArrow(run, OUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
