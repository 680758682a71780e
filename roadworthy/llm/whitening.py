"""Whitening of embeddings, with covariances from polarisation.

The vectors' components are whole numbers.  One pass adds them up (S, n); a
second adds the squares of n*x - S, the centred value times n, for every
dimension and for the sum of every two dimensions.  All of that is exact
whole-number arithmetic, so no order of summation and no large offset changes
a bit.  As var(a + b) = var(a) + 2 cov(a, b) + var(b), differences of those
variances give every covariance; the matrix goes to ``eigh``.  A third pass
measures the covariance that the whitened values really have.

What travels is per task one row for each dimension and pair, and the driver
holds one such set (2,080 numbers at 64 dimensions), whatever the number
of vectors.  Sums are sent in two parts, so that they may exceed 38 digits.

Defined results: vectors that are null or hold null or non-finite entries are
dropped, and so are those with an entry of 2^31 or more in absolute value, that
have no place on the grid; a zero vector and a repeated row count like any
other; rows without id stay; vectors of each length are fitted on their own,
an empty vector has no components; a component without variance (eigenvalue zero to double
precision) has null ``whitened`` and takes no part in ``identity_error``, which is
null where none is left; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadworthy.llm.common import setting

SCALE, OFFSET = 64, 1_000_000
LIMIT = 2.0 ** 31
#: Numbers of one block of pair sums.
BLOCK = 1 << 20
_LOW = 60


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, not finite or off the grid."""
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))


def grid(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): the usable vectors with every entry c as floor(scale * c) + offset."""
    x = F.transform(F.col(embedding).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset).cast("long"))
    return vectors.where(usable(F.col(embedding))).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of each vector length of a batch."""
    column = batch.column("x")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dim)


def squares(values: np.ndarray, axis: int) -> np.ndarray:
    """Exact sums of squares along an axis, as Python integers."""
    if values.dtype == object:
        return (values * values).sum(axis=axis)
    most, count = int(np.abs(values).max(initial=0)), values.shape[axis]
    if most * most * max(count, 1) < 1 << 63:
        return (values * values).sum(axis=axis).astype(object)
    if most >= 1 << 50 or count > 1 << 10:
        return squares(values.astype(object), axis)
    high = values >> 25
    low = values - (high << 25)
    parts = ((high * high).sum(axis=axis), (high * low).sum(axis=axis), (low * low).sum(axis=axis))
    hh, hl, ll = (p.astype(object) for p in parts)
    return (hh << 50) + (hl << 26) + ll


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n*x - S, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def pair_squares(c: np.ndarray) -> np.ndarray:
    """Sums of the squares of every column, then of every sum of two columns (upper triangle, by rows)."""
    left, right = np.triu_indices(c.shape[1], 1)
    total = np.zeros(c.shape[1] + len(left), object)
    step = min(1 << 10, max(1, BLOCK // max(1, len(left))))
    for a in range(0, len(c), step):
        rows = c[a:a + step]
        total[:c.shape[1]] += squares(rows, 0)
        total[c.shape[1]:] += squares(rows[:, left] + rows[:, right], 0)
    return total


def _totals(x: DataFrame, parts: Callable[[np.ndarray], np.ndarray]) -> dict[int, list[int]]:
    """Exact sums of ``parts`` over the vectors of each length; one partial sum a task and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in _matrices(batch):
                dim, made = matrix.shape[1], parts(matrix)
                sums[dim] = sums[dim] + made if dim in sums else made
        for dim, values in sums.items():
            exact = [int(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(exact), pa.int32()), pa.array(range(len(exact)), pa.int32()),
                 pa.array([Decimal(v >> _LOW) for v in exact], pa.decimal128(38, 0)),
                 pa.array([Decimal(v & ((1 << _LOW) - 1)) for v in exact], pa.decimal128(38, 0))],
                names=["dim", "item", "high", "low"])

    partial = x.select("x").mapInArrow(run, "dim int, item int, high decimal(38,0), low decimal(38,0)")
    found: dict[int, list[int]] = {}
    for r in partial.groupBy("dim", "item").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("dim", "item").collect():
        found.setdefault(r.dim, []).append((int(r.high) << _LOW) + int(r.low))
    return found


@dataclass
class Whitener:
    """One vector length's fit."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > len(self.sums) * np.finfo(float).eps * self.values.max(initial=0)

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n*x - S, whitened) of vectors; components without variance are NaN."""
        c = centred(x, self.sums, self.n)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = ((c / self.n).astype(np.float64) @ self.axes) / np.sqrt(np.where(self.live, self.values, np.nan))
        return c, w


def covariance(totals: list[int], n: int, dim: int) -> np.ndarray:
    """All covariances from ``pair_squares`` totals; each entry is one correctly rounded quotient."""
    v = np.zeros((dim, dim))
    for i in range(dim):
        v[i, i] = totals[i] / n ** 3
    for k, (i, j) in enumerate(zip(*np.triu_indices(dim, 1))):
        v[i, j] = v[j, i] = (totals[dim + k] - totals[i] - totals[j]) / (2 * n ** 3)
    return v


def fit(x: DataFrame, components: int | None = None) -> dict[int, Whitener]:
    """The whitening of each vector length of ``grid`` rows; at most ``components`` components are kept."""
    with setting(x.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):
        first = _totals(x, lambda m: np.append(m.astype(object).sum(axis=0) if m.shape[1] else np.zeros(0, object), len(m)))
        sums = {dim: (t[-1], t[:-1]) for dim, t in first.items() if dim}
        second = _totals(x.where(F.size("x") > 0), lambda m: pair_squares(centred(m, sums[m.shape[1]][1], sums[m.shape[1]][0]))) if sums else {}
        fits = {}
        for dim, (n, s) in sums.items():
            v = covariance(second[dim], n, dim)
            values, axes = np.linalg.eigh(v)
            values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
            # Either sign would do; the largest entry is positive, so that every fit gives the same.
            axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
            fits[dim] = Whitener(n, s, np.maximum(values, 0.0), axes, float(np.trace(v)))
        return _measured(x, fits)


def _measured(x: DataFrame, fits: dict[int, Whitener]) -> dict[int, Whitener]:
    """The fits with the largest difference of the whitened values' covariance from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in _matrices(batch):
                dim = matrix.shape[1]
                if dim in fits and fits[dim].live.any():
                    w = fits[dim].whiten(matrix)[1][:, fits[dim].live]
                    made = np.vstack((w.sum(axis=0), w.T @ w))
                    sums[dim] = sums.get(dim, 0.0) + made
        for dim, made in sums.items():
            flat = made.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())],
                names=["dim", "item", "part"])

    found: dict[int, list[float]] = {}
    sums = x.select("x").mapInArrow(run, "dim int, item int, part double").groupBy("dim", "item").agg(F.sum("part").alias("part"))
    for r in sums.orderBy("dim", "item").collect():
        found.setdefault(r.dim, []).append(r.part)
    for dim, flat in found.items():
        k = int(fits[dim].live.sum())
        mean, second = np.array(flat[:k]) / fits[dim].n, np.array(flat[k:]).reshape(k, k) / fits[dim].n
        fits[dim].identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return fits


def apply(x: DataFrame, fits: dict[int, Whitener]) -> DataFrame:
    """One row for each vector of ``grid`` rows and component of its length's fit.

    (vec_id, component, n, deviation, whitened, explained, identity_error);
    deviation, the sum of the squares of n*x - S, is decimal(38,0) and null where
    it has more digits.
    """
    id_type = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _matrices(batch):
                model = fits.get(matrix.shape[1])
                if model is None:
                    continue
                c, w = model.whiten(matrix)
                k, m = w.shape[1], len(rows)
                exact = [Decimal(int(v)) if v < 10 ** 38 else None for v in squares(c, 1)]
                share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n, np.int64)), pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, m), from_pandas=True),
                     pa.array([model.identity_error] * (m * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Fit on all usable ``vectors`` and whiten them; see ``apply`` for the columns."""
    x = grid(vectors, vec_id, embedding)
    return apply(x, fit(x, components))
