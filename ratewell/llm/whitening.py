"""Whitening of embeddings: a distributed centred scatter, and Jacobi rotations of it on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.texts import ensure_checkpoints, stored
from ratewell.llm.vectors import gathered, integers, matrix

#: Rows that are centred and multiplied at once.
ROWS = 8192
#: Shares of the trace that don't count as variance: vectors that lie in fewer dimensions have no more components.
NOTHING = 1e-14

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


class Moments(NamedTuple):
    """Number of vectors, exact sums of their entries, and the covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    An entry has vanished when it is tiny beside the two diagonal ones it couples, not beside the largest of all, so that
    small eigenvalues of a positive matrix keep their digits.
    """
    a = np.array(a, float)
    v = np.eye(len(a))
    tiny, floor = np.finfo(float).eps, np.finfo(float).tiny
    for _ in range(sweeps):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= max(tiny * np.sqrt(abs(a[p, p] * a[q, q])), floor):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                shift = t * a[p, q]
                own_p, own_q = a[p, p] - shift, a[q, q] + shift
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c * row_p - s * row_q, s * row_p + c * row_q
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = own_p, own_q, 0.0, 0.0
                col = v[:, p].copy()
                v[:, p], v[:, q] = c * col - s * v[:, q], s * col + c * v[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: n times the distance from the mean, exact; Python's integers where longs don't suffice."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if 2 * n * largest < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where it is no long."""
    if d.dtype != object and (d.astype(float) ** 2).sum(1).max(initial=0) < 2**62:
        return (d * d).sum(1).tolist()
    sums = (d.astype(object) ** 2).sum(1)
    return [int(s) if s < 2**63 else None for s in sums]


def _summed(parts: DataFrame, *keys: str) -> list:
    return parts.groupBy(*keys).agg(F.sum("value").alias("value")).collect()


def _pairs(dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(dims)


def _square(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((dims, dims))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def moments(vectors: DataFrame, dims: int) -> Moments:
    """Of (vec_id, x), in two passes: sums first, then products of what is centred. Each task sends dims * (dims + 1) / 2
    numbers, which are added up by the pair of entries; the driver gets as many in all."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dims + 1, np.int64)
        for batch in batches:
            sums[:dims] += matrix(batch.column("x"), dims).sum(0)
            sums[dims] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(sums)], names=["i", "value"])

    found = {r.i: int(r.value) for r in _summed(vectors.mapInArrow(totals, "i bigint, value bigint").withColumn("value", F.col("value").cast("decimal(38,0)")), "i")}
    n, sums = found.get(dims, 0), [found.get(i, 0) for i in range(dims)]
    up, down = _pairs(dims)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((dims, dims))
        for batch in gathered(batches, ROWS):
            y = centred(matrix(batch.column("x"), dims), n, sums).astype(float) / n
            scatter += y.T @ y
        yield pa.RecordBatch.from_arrays([*map(pa.array, (up, down, scatter[up, down]))], names=["i", "j", "value"])

    return Moments(n, sums, _square(_summed(vectors.mapInArrow(products, "i bigint, j bigint, value double"), "i", "j"), dims) / max(n, 1))


def whitened_rows(vectors: DataFrame, fit: Moments, values: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): the exact deviation, and the projections over the roots of the eigenvalues; a component
    without variance is null."""
    dims = len(fit.sums)
    n, sums, there = fit.n, fit.sums, values > 0
    scaled = axes[:, there] / np.sqrt(values[there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, ROWS):
            d = centred(matrix(batch.column("x"), dims), n, sums)
            w = np.full((len(d), len(values)), np.nan)
            w[:, there] = (d.astype(float) / n) @ scaled
            flat = pa.array(w.ravel(), from_pandas=True)  # nan becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(values), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(d), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    return vectors.mapInArrow(run, "vec_id bigint, deviation bigint, w array<double>")


def identity_error(rows: DataFrame, n: int, there: np.ndarray) -> float:
    """Largest absolute entry of the covariance of w, over components with variance, minus the identity. The rows were
    centred before they were projected."""
    k = len(there)
    up, down = _pairs(k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((k, k))
        for batch in gathered(batches, ROWS):
            w = np.nan_to_num(matrix(batch.column("w"), k))
            scatter += w.T @ w
        yield pa.RecordBatch.from_arrays([*map(pa.array, (up, down, scatter[up, down]))], names=["i", "j", "value"])

    covariance = _square(_summed(rows.select("w").mapInArrow(products, "i bigint, j bigint, value double"), "i", "j"), k) / n
    return float(np.abs(covariance - np.eye(k))[np.ix_(there, there)].max(initial=0.0))


def whitening(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds an entry that is null or no finite number are dropped. Entries become
    floor(scale * entry) + shift, and all vectors are the fit: their mean is taken away and they are projected on the
    eigenvectors of their covariance, over the roots of the eigenvalues. The dims x dims covariance goes to the driver, and
    dims x components numbers come back with the tasks' code; rows never do.

    Vectors of several lengths have no common space: those of the most frequent length (the longest of equals) stay. An
    empty table, or empty vectors only: no rows. Components without variance (a single vector, repeated rows, fewer
    dimensions): whitened is null and identity_error leaves them out. deviation is null where it exceeds a long. Rows that
    repeat an id count each; null ids stay. Extra columns are ignored. Entries of 2**27 / scale and more are an error.
    Needs spark.checkpoint.dir.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    vectors = integers(df, id_col, vec_col, scale, shift)
    dims = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not dims or not dims[0].dims:
        return spark.createDataFrame([], RESULT)
    vectors = vectors.filter(F.size("x") == dims[0].dims)
    fit = moments(vectors, dims[0].dims)
    trace = float(np.trace(fit.covariance))
    values, axes = jacobi(fit.covariance)
    values, axes = values[:components], axes[:, :components]
    values = np.where(values > NOTHING * trace, values, 0.0)
    rows = stored(whitened_rows(vectors, fit, values, axes))
    error = identity_error(rows, fit.n, values > 0)
    explained = F.array(*(F.lit(float(v / trace)) if trace else F.lit(0.0) for v in values))
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
