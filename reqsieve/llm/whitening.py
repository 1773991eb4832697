"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Vectors become whole numbers first (``floor(scale * entry)``). The fit list holds each distinct vector
once. Its scatter is summed from vectors centred at the whole numbers next to the means, so that all
products and sums are exact up to 2**53, whatever their order; what is left of the centring is
put right in exact fractions. Cholesky with the largest remaining diagonal first gives a triangular
factor L of the covariance, and one-sided Jacobi rotations make the columns of L orthogonal:
their squared norms are the eigenvalues, the columns over their norms are the components.

Only sums of one row per dimension reach the driver, whose work depends on the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.session import Scratch, cut_lineage

SCALE, COMPONENTS = 256, 4
_SWEEPS = 60


class Whitener(NamedTuple):
    n: int  # distinct vectors
    sums: list[int]  # of each dimension
    values: np.ndarray  # eigenvalues of the components, falling
    components: np.ndarray  # dimensions x components
    total: float  # trace of the covariance


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """L of ``L @ L.T == matrix``, rows in the matrix's own order, one column per positive pivot."""
    size = len(matrix)
    left, factor = np.diagonal(matrix).astype(np.float64).copy(), np.zeros((size, size))
    least = size * np.finfo(np.float64).eps * left.max(initial=0.0)
    done = np.zeros(size, bool)
    for k in range(size):
        pivot = int(np.argmax(np.where(done, -np.inf, left)))
        if left[pivot] <= least:
            return factor[:, :k]
        root = np.sqrt(left[pivot])
        column = (matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / root
        column[done], column[pivot] = 0.0, root
        factor[:, k] = column
        left -= column * column
        done[pivot] = True
    return factor


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor @ factor.T``, falling, and their unit eigenvectors as columns.

    Columns are rotated in pairs, all pairs of a round at once, until all are orthogonal. Of
    each vector the entry of largest size is positive (ties: the first such entry).
    """
    columns = factor.copy()
    rank = columns.shape[1]
    if not rank:
        return np.zeros(0), columns
    seats = np.arange(rank + rank % 2)  # round robin; an odd number has one seat empty
    for _ in range(_SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            a, b = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (a < rank) & (b < rank)
            a, b = a[real], b[real]
            x, y = columns[:, a], columns[:, b]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx) * np.sqrt(yy)
            turn = np.abs(xy) > 1e-16 * size
            worst = max(worst, float(np.max(np.abs(xy[turn]) / size[turn], initial=0.0)))
            tau = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            t = np.where(turn, np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau)), 0.0)
            c = 1 / np.hypot(1.0, t)
            columns[:, a], columns[:, b] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst < 1e-15:
            break
    norms = np.sqrt((columns * columns).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    vectors = columns[:, order] / norms[order]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    return norms[order] ** 2, vectors * sign


# --- vectors --------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite entries."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * entry)`` of each entry as a long; null where a long does not hold it."""
    most = float(1 << 63)

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when((scaled >= -most) & (scaled < most), F.floor(scaled))

    return F.transform(vector, whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _added(parts: DataFrame) -> DataFrame:
    """Rows ``(row, values)`` of packed doubles, added up by row; one task holds some of the rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(values.as_py())
                sums[row] = sums[row] + part if row in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["row", "values"])

    return parts.repartition("row").mapInArrow(task, "row int, values binary")


def _scatter(rows: DataFrame, centre: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Sum of products of the centred rows ``x``, of their projections if ``project`` is given."""
    width = len(centre)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            values = _matrix(batch.column(0), width) - centre
            values = (values if project is None else values @ project).astype(np.float64)
            total = values.T @ values if total is None else total + values.T @ values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], names=["row", "values"])

    summed = _added(rows.select("x").mapInArrow(task, "row int, values binary")).collect()  # one row per dimension
    return np.stack([np.frombuffer(r["values"]) for r in sorted(summed, key=lambda r: r["row"])])


def covariance(distinct: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and covariance (divisor: the number) of rows ``x`` of one width; 0 without rows or entries."""
    sums = distinct.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    found = sorted(sums.collect())  # one row per dimension
    if not found:
        return 0, [], np.zeros((0, 0))
    n, totals = found[0]["n"], [int(r["s"]) for r in found]
    centre = [round(Fraction(s, n)) for s in totals]
    scatter = _scatter(distinct, np.array(centre, np.int64))
    # the centre is off the mean by a fraction; what that adds to the scatter is taken off exactly
    off = [s - n * c for s, c in zip(totals, centre)]
    size = len(off)
    exact = [[float(Fraction(n * int(scatter[i, j]) - off[i] * off[j], n * n)) for j in range(i + 1)] for i in range(size)]
    return n, totals, np.array([[exact[max(i, j)][min(i, j)] for j in range(size)] for i in range(size)])


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The leading components of rows ``x``, each counted once; None if there are none."""
    n, sums, matrix = covariance(distinct)
    values, vectors = one_sided_jacobi(pivoted_cholesky(matrix))
    if not len(values):
        return None
    return Whitener(n, sums, values[:components], vectors[:, :components], float(np.trace(matrix)))


def identity_error(distinct: DataFrame, model: Whitener) -> float:
    """Largest entry, in size, of the covariance of the whitened fit list minus the identity, from the list itself."""
    mean = np.array([s / model.n for s in model.sums])
    measured = _scatter(distinct, mean, model.components / np.sqrt(model.values)) / model.n
    return float(np.abs(measured - np.eye(len(measured))).max())


def whiten(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: rows times components.

    Left out: a null vector, and one with a null or non-finite entry or an entry whose
    whole number no long holds. All others must be of one length, else an error says so. ``n`` counts
    the distinct vectors, ``deviation`` is the squared distance to the mean, times ``n``
    squared (null if no long holds it). Components without variance are not listed, so equal
    vectors alone, vectors of length 0 and an empty table give no rows. Repeated rows stay rows and
    do not change the fit; the id may be null. Other columns play no part.
    """
    with Scratch(vectors.sparkSession, "whitening") as scratch:
        rows = vectors.filter(usable(F.col(vector))).select(F.col(id).alias("vec_id"), whole_numbers(F.col(vector), scale).alias("x"))
        rows = rows.filter(~F.exists("x", lambda v: v.isNull()))
        distinct = scratch.table(rows.select("x").distinct(), "distinct")
        least, most = distinct.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        if least != most:
            raise ValueError(f"vectors of different lengths, from {least} to {most}, have no covariance")
        model = fit(distinct, components)
        error = identity_error(distinct, model) if model else 0.0
        return cut_lineage(_projected(rows, model, error), "whitened")


def _projected(rows: DataFrame, model: Whitener | None, error: float) -> DataFrame:
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), *(T.StructField(*f) for f in fields)])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, values, components, total = shared.value
        count, largest = len(values), max(map(abs, sums))
        mean = np.array([s / n for s in sums])
        for batch in batches:
            x = _matrix(batch.column("x"), len(sums))
            whitened = (x - mean) @ (components / np.sqrt(values))
            bound = n * int(np.abs(x).max(initial=0)) + largest
            kind = np.int64 if len(sums) * bound * bound < 1 << 63 else object  # beyond: Python's own numbers
            apart = n * x.astype(kind) - np.array(sums, kind)
            deviation = [int(d) if d < 1 << 63 else None for d in (apart * apart).sum(axis=1).tolist()]
            places = np.repeat(np.arange(len(batch)), count)
            numbers = pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(batch)))
            same = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(len(places), np.int64)))
            columns = [
                batch.column("vec_id").take(pa.array(places)),
                numbers,
                same(n, pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(places)),
                pa.array(whitened.ravel()),
                pa.array(np.tile(values / total, len(batch))),
                same(error, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(task, schema)
