"""Embedding whitening: components of the covariance by contour integration (FEAST).

The covariance is summed on Spark; what reaches the driver is one matrix of the vectors' dimension,
whatever the number of rows. There inertia counts cut the spectrum into intervals of a few eigenvalues.
For each interval a quadrature over a circle around it sums complex shifted solves ``(z - V)^-1 Y``,
which projects random vectors onto the interval's eigenvectors; Rayleigh-Ritz in that subspace gives
the components, and the interval is done only when it holds as many as the inertia says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become ``floor(SCALE * c) + OFFSET``; entries of this size or more have no exact long.
SCALE, OFFSET, LIMIT = 64, 1_000_000, float(1 << 31)
#: Eigenvalues of an interval, nodes of the quadrature on the half circle, most projections in a row.
FEW, NODES, ROUNDS = 8, 8, 30
#: Directions with less of the largest eigenvalue than this have no variance that doubles can tell.
NO_VARIANCE = 1e-10
#: Rows turned into output at once.
ROWS = 2000


class Fit(NamedTuple):
    """Rows, sums of a dimension, eigenvalues (falling), unit eigenvectors as columns, trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are below ``shift``.

    By Sylvester's law of inertia these are the negative pivots of ``v - shift``. Bunch and Parlett's
    pivots of one or two rows keep the factors small; one of two rows has one negative eigenvalue.
    """
    a, count = v - shift * np.eye(len(v)), 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        beside = np.abs(a)
        np.fill_diagonal(beside, 0)
        one = int(diagonal.argmax())
        if diagonal[one] >= (1 + 17**0.5) / 8 * beside.max():
            if diagonal[one] == 0:
                break
            pivot = [one]
            count += int(a[one, one] < 0)
        else:
            pivot = list(divmod(int(beside.argmax()), len(a)))
            count += 1
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
    return count


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` of intervals that hold the ``wanted`` largest eigenvalues, highest first.

    Halved until an interval holds FEW at most, or is too narrow to halve (a repeated eigenvalue).
    """
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    if not top:
        return []
    low = top * NO_VARIANCE
    left, out, have = [(low, top, below(v, low), len(v))], [], 0
    while left and have < wanted:
        low, high, under, over = left.pop()
        if over == under:
            continue
        middle = (low + high) / 2
        if over - under <= FEW or high - low <= 256 * np.finfo(float).eps * top:
            out.append((low, high, over - under))
            have += over - under
        else:
            between = below(v, middle)
            left += [(low, middle, under, between), (middle, high, between, over)]
    return out


def project(v: np.ndarray, low: float, high: float, start: np.ndarray) -> np.ndarray:
    """``start`` filtered to the eigenvectors between ``low`` and ``high``: the integral of the shifted
    solves along the upper half of a circle, by Gauss and Legendre's nodes. The lower half is its
    conjugate, so the real part is all that counts."""
    middle, radius, one = (low + high) / 2, (high - low) / 2, np.eye(len(v))
    out = np.zeros_like(start)
    for x, weight in zip(*np.polynomial.legendre.leggauss(NODES)):
        turn = np.exp(0.5j * np.pi * (1 - x))
        solved = np.linalg.solve((middle + radius * turn) * one - v, start.astype(complex))
        out += 0.5 * weight * (radius * turn * solved).real
    return out


def ritz(v: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values and unit vectors of ``v`` in the span of the columns."""
    base = np.linalg.qr(span)[0]
    small = base.T @ v @ base
    values, turned = np.linalg.eigh((small + small.T) / 2)
    return values, base @ turned


def within(v: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """The ``count`` eigenvectors between ``low`` and ``high``.

    A subspace that is too small, or random vectors that miss one, leave the count short or the
    residuals large; then the subspace is doubled, at last to the whole space.
    """
    size, dims, scale = 2 * count + 4, len(v), float(np.abs(v).sum(axis=1).max())
    enough = 16 * np.finfo(float).eps * scale * dims**0.5
    while size < dims:
        span, before = np.random.default_rng(size).standard_normal((dims, size)), np.inf
        for _ in range(ROUNDS):
            values, span = ritz(v, project(v, low, high, span))
            inside = (values >= low) & (values < high)
            found = span[:, inside]
            if inside.sum() == count:
                residual = float(np.abs(v @ found - found * values[inside]).max())
                if residual <= enough or before / 2 < residual <= 1e3 * enough:
                    return found
                before = residual
        size *= 2
    values, span = ritz(v, np.eye(dims))
    order = np.argsort(np.maximum(low - values, values - high), kind="stable")[:count]
    return span[:, np.sort(order)]


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and unit eigenvectors as columns.

    Fewer where the rest has no variance. A last Rayleigh-Ritz over all intervals makes vectors of
    neighbouring intervals orthogonal, too.
    """
    parts = intervals(v, wanted)
    if not parts:
        return np.empty(0), np.empty((len(v), 0))
    values, vectors = ritz(v, np.hstack([within(v, *part) for part in parts]))
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, c)`` of the rows whose vector has entries, all of them finite and below LIMIT / SCALE."""
    c = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(c, lambda e: e.isNotNull() & (F.abs(e) < LIMIT / SCALE))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), c.alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & fine
    )


def longs(c: pa.ListArray, size: int) -> np.ndarray:
    """The vectors of a batch as rows of longs."""
    flat = c.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(-1, size)


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums of a dimension, of the vectors of the commonest length (ties: the longest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = b.column("c").value_lengths().to_numpy()
            for size in np.unique(lengths).tolist():
                x = longs(b.column("c").take(pa.array(np.flatnonzero(lengths == size))), size)
                held[size] = held.get(size, 0) + np.concatenate([[len(x)], x.sum(axis=0)])
        if held:
            yield pa.RecordBatch.from_pydict({"size": list(held), "sums": list(held.values())}, pa.schema([("size", pa.int32()), ("sums", pa.list_(pa.int64()))]))

    parts = rows.mapInArrow(run, "size int, sums array<long>").select("size", F.posexplode("sums").alias("i", "x"))
    summed = parts.groupBy("size", "i").agg(F.sum("x").alias("x"))
    best = summed.where("i = 0").orderBy(F.desc("x"), F.desc("size")).first()
    if best is None:
        return 0, np.empty(0, np.int64)
    found = {r["i"]: r["x"] for r in summed.where(F.col("size") == best["size"]).collect()}
    return best["x"], np.array([found[i] for i in range(1, best["size"] + 1)], np.int64)


def moments(rows: DataFrame, size: int, width: int, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of ``prepare(x)``, ``width`` numbers a vector; a task sends one triangle."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = prepare(longs(b.column("c").slice(at, ROWS), size))
                total += part.T @ part
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"sums": [total[upper]]}, pa.schema([("sums", pa.list_(pa.float64()))]))

    parts = rows.select("c").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[upper[0][r["i"]], upper[1][r["i"]]] = r["x"]
    return np.triu(out) + np.triu(out, 1).T


def fit(rows: DataFrame, wanted: int = 32) -> Fit:
    """Components of the covariance of all vectors of ``rows``, centred before they are multiplied."""
    n, sums = totals(rows)
    if not n:
        return Fit(0, sums, np.empty(0), np.empty((0, 0)), 0.0)
    size = len(sums)
    v = moments(rows.where(F.size("c") == size), size, size, lambda x: (n * x - sums) / n) / n
    return Fit(n, sums, *components(v, min(wanted, size)), float(np.trace(v)))


def deviations(d: np.ndarray) -> pa.Array:
    """Exact sums of squares of the rows of a matrix of longs, as decimals."""
    if float((d.astype(float) ** 2).sum(axis=1).max(initial=0)) < 2.0**62:
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(x) for x in (d.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = 32) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per vector and component.

    Vectors that are null or empty, hold null or non-finite entries or entries of 2^25 and more (their
    squares would not be exact), or are not of the commonest length (ties: the longest) take no part.
    Repeated rows count and return as often as they occur; ties of eigenvalues leave any basis of their
    space; ids may be null; other columns don't matter. Components end where there is no variance left:
    a single row, equal rows and an empty table give no rows. ``deviation`` is decimal(38, 0), as large
    tables exceed a long. ``identity_error`` is measured on the whitened vectors themselves.
    """
    rows = usable(df, id_col, vector_col)
    n, sums, values, vectors, trace = fit(rows, wanted)
    size, width = len(sums), len(values)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    rows, scaled, explained = rows.where(F.size("c") == size), vectors / np.sqrt(values), values / trace
    seen = moments(rows, size, width, lambda x: ((n * x - sums) / n) @ scaled) / n
    error = float(np.abs(seen - np.eye(width)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                d = n * longs(b.column("c"), size) - sums
                each = pa.array(np.repeat(np.arange(len(d)), width))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(d))),
                        pa.array(np.full(len(d) * width, n)),
                        deviations(d).take(each),
                        pa.array(((d / n) @ scaled).ravel()),
                        pa.array(np.tile(explained, len(d))),
                        pa.array(np.full(len(d) * width, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
