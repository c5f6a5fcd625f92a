"""Embedding whitening from an exact integer scatter.

Vectors become integers, and each distinct one is fitted once.  Tasks subtract a shift and add up the vectors' sums S and
cross-products XᵀX as integers of any size, in rounds of bounded fan-in; n·XᵀX - SSᵀ, which doesn't depend on the shift, is
formed exactly by the driver from matrices whose size is the vectors', and only then turned into doubles and decomposed.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .common import materialize, tidied, tree_sum
from .vectors import longest, scaled, usable

#: Integers below this are exact in doubles.
EXACT = 1 << 53
#: Vectors with an entry beyond this aren't taken: their integers would not fit a long.
MOST_ENTRY = float(1 << 62)


def _integers(rows: DataFrame, dims: int, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): the vectors' longs as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(start, 1 << 14)
                x = scaled(part.column(1), dims, scale)
                fits = (np.abs(x) < MOST_ENTRY).all(axis=1)
                kept = x[fits].astype("<i8") + offset
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fits)), pa.array([v.tobytes() for v in kept], pa.binary())], names=["vec_id", "x"])

    ship(rows.sparkSession)
    return rows.mapInArrow(tidied(run), "vec_id long, x binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dims)


def scatter(x: np.ndarray) -> list[np.ndarray]:
    """The number of rows, their sums and their cross-products (row by row of the matrix), as Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    step, dims = (EXACT - 1) // (most * most), x.shape[1]
    sums, products = np.zeros(dims, object), np.zeros(dims * dims, object)
    if step:  # so many products add up exactly in doubles
        for start in range(0, len(x), min(step, 4096)):
            part = x[start : start + min(step, 4096)].astype(np.float64)
            sums = sums + part.sum(axis=0).astype(np.int64).astype(object)
            products = products + (part.T @ part).astype(np.int64).ravel().astype(object)
    else:
        big = x.astype(object)
        sums, products = big.sum(axis=0) + sums, big.T.dot(big).ravel() + products
    return [np.array([len(x)], object), sums, products]


class Whitening:
    """What was fitted: n, S, and of each component its direction, eigenvalue and share of the variance."""

    def __init__(self, n: int, sums: list[int], scattered: list[int], components: int):
        """scattered: n·XᵀX - SSᵀ, row by row; the covariance is this over n²."""
        dims = len(sums)
        self.n, self.sums = n, sums
        covariance = np.array([v / (n * n) for v in scattered]).reshape(dims, dims)  # the quotient of two integers, rounded once
        values, vectors = np.linalg.eigh(covariance) if dims else (np.zeros(0), np.zeros((0, 0)))
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = sum(scattered[i * dims + i] for i in range(dims)) / (n * n)
        rank = int((values > max(trace, 0) * dims * np.finfo(float).eps).sum())
        self.kept = min(components, rank)
        self.vectors, self.values = vectors[:, : self.kept], values[: self.kept]
        self.explained = self.values / trace if self.kept else self.values

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S/n as doubles, and the sum of (n·x - S)² of each row, exactly."""
        sums, least, most = self.sums, int(x.min(initial=0)), int(x.max(initial=0))
        largest = max([abs(self.n * v - s) for s in sums for v in (least, most)], default=0)
        if largest * largest * max(len(sums), 1) < 1 << 63 and self.n * max(abs(least), abs(most)) < 1 << 63:
            away = self.n * x - np.array(sums, np.int64)[None, :]
            return away / self.n, (away * away).sum(axis=1).tolist()
        away = self.n * x.astype(object) - np.array(sums, object)[None, :]
        return np.array([[v / self.n for v in row] for row in away], np.float64).reshape(x.shape), [sum(v * v for v in row) for row in away.tolist()]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)[None, :]


def fit(distinct: DataFrame, dims: int, components: int, shift: int) -> tuple[Whitening | None, float]:
    """From distinct vectors (x): the transformation, and how far the covariance of what it makes is from the identity at most."""
    found = tree_sum(distinct, lambda b: scatter(matrix(b.column(0), dims) - shift), exact=True)
    if not found:
        return None, 0.0
    (n,), sums, products = (a.tolist() for a in found)
    scattered = [n * products[i * dims + j] - sums[i] * sums[j] for i in range(dims) for j in range(dims)]
    made = Whitening(n, [s + n * shift for s in sums], scattered, components)
    if not made.kept:
        return made, 0.0
    value = lambda b: made.whitened(made.centred(matrix(b.column(0), dims))[0])
    mean = tree_sum(distinct, lambda b: [value(b).sum(axis=0)])[0] / n

    def products_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        w = value(batch) - mean
        return [(w.T @ w).ravel()]

    covariance = (tree_sum(distinct, products_of)[0] / n).reshape(made.kept, made.kept)
    return made, float(np.abs(covariance - np.eye(made.kept)).max())


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row and component.

    An entry c counts as the long x = floor(scale * c) + offset.  Fitted are the n distinct vectors, whose sums are S: components
    are the eigenvectors of their covariance by falling eigenvalue from 1 on, as many as ``components`` or as the covariance has
    eigenvalues above rounding (a table of one distinct vector has none and gives no row).  ``deviation`` is the sum of (n·x - S)²,
    null if a long doesn't hold it.  Null vectors and those that hold a null, a number that isn't finite or one beyond 2^62 over
    ``scale`` are left out; shorter vectors count as ending in zeros.  Rows keep their number, identifiers may be null or
    repeated; an empty table gives no row; other columns are ignored.
    """
    if components < 1:
        raise ValueError("components must be 1 or more")
    rows = usable(df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].alias("__own")), "vec_id", "__own")
    _, dims = longest(rows)
    held = materialize(_integers(rows, dims, scale, offset), "vectors")
    distinct = materialize(held.select("x").distinct(), "distinct")
    made, error = fit(distinct, dims, components, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(start, 1 << 12)
                centred, deviation = made.centred(matrix(part.column(1), dims))
                w, k = made.whitened(centred), made.kept
                row = np.repeat(np.arange(len(w)), k)
                fit_long = pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(row), made.n)), fit_long.take(pa.array(row)), pa.array(w.ravel()), pa.array(np.tile(made.explained, len(w))), pa.array(np.full(len(row), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if made is None or not made.kept:
        return held.sparkSession.createDataFrame([], schema)
    return held.mapInArrow(tidied(run), schema)
