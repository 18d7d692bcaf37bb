"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries are made integers on a grid of 1/64 (what the contract adds to them falls out of all that is centred), so that
sums and centred products are exact in any order of tasks. The scatter about the mean, d x d, is factored as L L' with
pivots; plane rotations of L's columns from the right, until they are orthogonal, give it as U S: the columns' norms are
the roots of the eigenvalues and the columns over their norms the components, without ever forming a product again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import finite_rows, usual_length

#: Steps of the grid in a unit; grid values that are no more exact as doubles make a vector unusable.
GRID, MOST = 64, 2.0**48
#: Components with less than this share of the greatest variance are rounding only.
LEAST_SHARE = 1e-13


def grid_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of longs floor(64 * c)) of the usable vectors, by length."""
    out = []
    for rows, x in finite_rows(column):
        fits = (np.abs(x) < MOST / GRID).all(axis=1)
        if fits.any():
            out.append((rows[fits], np.floor(GRID * x[fits]).astype(np.int64)))
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each dimension by vector length, exact; one row a task, length and dimension."""
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for rows, x in grid_rows(batch.column("e")):
            d = x.shape[1]
            n[d] = n.get(d, 0) + len(rows)
            sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), x.sum(axis=0).tolist(), strict=True)]
    for d, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()), pa.array([Decimal(s) for s in own], pa.decimal128(38, 0))], names=["d", "i", "n", "s"])


def _products(near: np.ndarray):
    """Sums of products of grid values less whole numbers near the means; doubles of whole numbers, exact below 2^53."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(near)
        sums = np.zeros((d, d))
        for batch in batches:
            for _, x in grid_rows(batch.column("e")):
                if x.shape[1] == d:
                    y = (x - near).astype(float)
                    sums += y.T @ y
        i, j = np.tril_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])], names=["i", "j", "s"])

    return run


def gathered(rows: DataFrame, d: int) -> np.ndarray:
    """A symmetric d x d matrix of summed (i, j, s) rows of its lower triangle."""
    out = np.zeros((d, d))
    for r in rows.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of full column rank, rows in the order of a, with L L' = a to rounding; the largest remaining diagonal entry is the next pivot."""
    left = np.diag(a).astype(float).copy()
    d = len(left)
    out = np.zeros((d, d))
    for k in range(d):
        p = int(left.argmax())
        if left[p] <= d * np.finfo(float).eps * max(a.diagonal().max(), 0.0):
            return out[:, :k]
        column = (a[:, p] - out[:, :k] @ out[p, :k]) / np.sqrt(left[p])
        column[left == -np.inf] = 0.0  # rows of earlier pivots: the factor is a triangle
        out[:, k] = column
        left -= column * column
        left[p] = -np.inf
    return out


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(norms, unit columns) of a after plane rotations that make its columns orthogonal, by falling norm.

    In each step of a sweep all columns are paired, as in a tournament where one stays and the others move round.
    """
    g = a.copy()
    d, m = g.shape
    circle = np.concatenate([np.arange(m), np.full(m % 2, -1)])
    half = len(circle) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(1, len(circle) - 1)):
            p, q = circle[:half], circle[half:][::-1]
            there = (p >= 0) & (q >= 0)
            p, q = p[there], q[there]
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            angle = np.abs(gamma) / np.sqrt(alpha * beta)
            turn = angle > np.finfo(float).eps
            worst = max(worst, angle.max(initial=0.0))
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            x, y = x[:, turn], y[:, turn]
            g[:, p[turn]], g[:, q[turn]] = c * x - c * t * y, c * t * x + c * y
            circle = np.concatenate([circle[:1], circle[-1:], circle[1:-1]])
        if worst < 4 * d * np.finfo(float).eps:
            break
    norms = np.sqrt((g * g).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order], g[:, order] / norms[order]


class Fit:
    """n and S of the fit list, its components and their eigenvalues. sums: S without the offset."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, most: int):
        self.n, self.sums = n, sums
        self.near = np.array([s // n for s in sums], np.int64)
        rest = np.array([float(s % n) / n for s in sums])  # the mean lies that far above near
        scatter = products - n * np.outer(rest, rest)
        norms, components = one_sided_jacobi(pivoted_cholesky(scatter)) if len(sums) else (np.zeros(0), np.zeros((0, 0)))
        values = norms * norms / n
        trace = float(np.trace(scatter)) / n
        keep = values[:most] > LEAST_SHARE * max(values.max(initial=0.0), 0.0)
        components = components[:, :most][:, keep]
        at = np.abs(components).argmax(axis=0) if components.size else np.zeros(0, int)
        self.components = components * np.where(components[at, np.arange(components.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
        self.values = values[:most][keep]
        self.explained = self.values / trace if trace > 0 else self.values
        self.identity_error = 0.0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 over the dimensions, null where they are beyond a long."""
        reach = self.n * int(np.abs(x - self.near).max(initial=0) + 1)
        if len(self.sums) * reach * reach < 1 << 63:
            y = (x - self.near) * self.n - np.array([s % self.n for s in self.sums], np.int64)
            return (y * y).sum(axis=1).tolist()
        sums = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [s if s < 1 << 63 else None for s in sums]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.near).astype(float) - np.array([float(s % self.n) / self.n for s in self.sums])
        return centred @ self.components / np.sqrt(self.values)


def _moments(sent):
    """Sums of whitened values (j = -1) and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = sent.value
        c = len(fit.values)
        sums, products = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            for _, x in grid_rows(batch.column("e")):
                if x.shape[1] == len(fit.sums):
                    w = fit.whitened(x)
                    sums += w.sum(axis=0)
                    products += w.T @ w
        i, j = np.tril_indices(c)
        i, j, s = np.concatenate([np.arange(c), i]), np.concatenate([np.full(c, -1), j]), np.concatenate([sums, products[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s)], names=["i", "j", "s"])

    return run


def _rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = sent.value
        c = len(fit.values)
        names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for rows, x in grid_rows(batch.column("e")):
                if x.shape[1] != len(fit.sums):
                    continue
                m = len(rows) * c
                deviation = pa.array(fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), c)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(rows, c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, fit.n, np.int64)), deviation,
                    pa.array(fit.whitened(x).ravel()), pa.array(np.tile(fit.explained, len(rows))), pa.array(np.full(m, fit.identity_error)),
                ], names=names)

    return run


RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_whitening(vectors: DataFrame, embedding: str = "embedding", most: int = 32) -> Fit | None:
    """The whitening of all usable vectors of a table, None without any: two readings, of which the driver gets sums only, and a third for the error."""
    given = vectors.select(F.col(embedding).alias("e"))
    lengths: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = {}
    for r in given.mapInArrow(_sums, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        lengths[r["d"]] = r["n"]
        sums.setdefault(r["d"], {})[r["i"]] = int(r["s"])
    d = usual_length(lengths)
    if not d:
        return None
    own = [sums[d][i] for i in range(d)]
    near = np.array([s // lengths[d] for s in own], np.int64)
    fit = Fit(lengths[d], own, gathered(given.mapInArrow(_products(near), "i int, j int, s double"), d), most)
    c = len(fit.values)
    if c:
        sent = vectors.sparkSession.sparkContext.broadcast(fit)
        moments = given.mapInArrow(_moments(sent), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        covariance, mean = np.zeros((c, c)), np.zeros(c)
        for r in moments:
            if r["j"] < 0:
                mean[r["i"]] = r["s"] / fit.n
            else:
                covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = r["s"] / fit.n
        # whitened values are centred already; what rounding leaves of their mean goes too
        fit.identity_error = float(np.abs(covariance - np.outer(mean, mean) - np.eye(c)).max())
    return fit


def whiten(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", most: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every usable vector and component.

    Vectors that are null, empty, hold null or non-finite components or components of 2^42 or more in size are left out,
    and so are those of another length than most have (of ties the longer). Repeated rows, rows of null or equal key are vectors of
    their own. Components whose variance is nothing but rounding aren't given: none if all vectors are equal, or there
    is only one. A deviation beyond a long is null. Other columns are not read. An empty table gives an empty result.
    """
    fit = fit_whitening(vectors, embedding, most)
    spark = vectors.sparkSession
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], RESULT).withColumnRenamed("id", key)
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e"))
    return given.mapInArrow(_rows(spark.sparkContext.broadcast(fit)), RESULT).withColumnRenamed("id", key)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened, for up to 32 components."""
    from .common import table

    return whiten(table(spark, sf_dir, "embeddings"))
