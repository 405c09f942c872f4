"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries c become integers x = floor(scale * c) + shift. The fit list holds every distinct x vector once. Tasks sum its
vectors, then the scatter of z = x minus the rounded means: one d by d matrix a task, added up by entry. All of these are
sums of integers, so they are exact and alike in any order while below 2^53. What the rounding left (r = S - n * means) is
taken out of the scatter in exact integers, and the covariance is the scatter over n. The driver holds d by d numbers
only: it factors the covariance by Cholesky with diagonal pivoting, rotates pairs of columns of the triangular factor until
all are orthogonal, and reads eigenvalues off the squared column norms and components off the normalised columns.
A last pass over the fit list measures the whitened covariance itself.

Rows whose vector is null or holds null or non-finite entries take no part; a missing id stays. Vectors shorter than the
longest count as 0 beyond their end. Components without variance are left out, so equal vectors, one vector or none give
no rows. Entries beyond 2^60 count as 2^60; deviations that don't fit in a long are null; beyond 2^53 sums are doubles.
Extra columns are left out, whatever their names. Repeated rows are all returned, and count once in the fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import written

SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 60)
#: A pivot below so many times the largest one, times the dimension, is rounding.
NOTHING = 2.0 ** -52


@dataclass
class Whitening:
    """A fitted whitening: n distinct vectors with sums S, and the leading components by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray  # d x k, unit columns
    trace: float
    identity_error: float = 0.0

    @property
    def means(self) -> np.ndarray:
        """Means rounded to integers."""
        return np.array([round(Fraction(s, max(1, self.n))) for s in self.sums], np.int64)

    @property
    def remainders(self) -> list[int]:
        return [s - self.n * int(m) for s, m in zip(self.sums, self.means)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) on the components, over the root of the eigenvalues."""
        z = (x - self.means).astype(np.float64) - np.array(self.remainders, np.float64) / max(1, self.n)
        return z @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly; None where it doesn't fit in a long."""
        z, r = x - self.means, np.array(self.remainders, np.int64)
        far = self.n * np.abs(z).max(axis=1, initial=0).astype(np.float64) + np.abs(r).max(initial=0)
        safe = far * far * max(1, z.shape[1]) < 2.0 ** 62
        out: list[int | None] = [None] * len(x)
        for i, total in zip(np.flatnonzero(safe), ((self.n * z[safe] - r) ** 2).sum(axis=1)):
            out[i] = int(total)
        for i in np.flatnonzero(~safe):
            total = sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(z[i], r))
            out[i] = total if total < 1 << 63 else None
        return out


def whole(vector: Column, width: int, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """x of every entry, filled up to the width; null where the vector takes no part."""
    c = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long") + shift)
    return F.when(vector.isNotNull() & ~bad, F.concat(x, F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size(x))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular factor and order with v[order][:, order] = factor @ factor.T, as many columns as the rank."""
    d = len(v)
    factor, rest, order = np.zeros((d, d)), v.diagonal().astype(np.float64).copy(), np.arange(d)
    least = NOTHING * d * rest.max(initial=0)
    rank = 0
    while rank < d:
        pivot = rank + int(np.argmax(rest[order[rank:]]))
        if not rest[order[pivot]] > least:
            break
        order[[rank, pivot]] = order[[pivot, rank]]
        at, below = order[rank], order[rank + 1:]
        factor[at, rank] = np.sqrt(rest[at])
        factor[below, rank] = (v[below, at] - factor[below, :rank] @ factor[at, :rank]) / factor[at, rank]
        rest[below] -= factor[below, rank] ** 2
        rank += 1
    return factor[order, :rank], order


def pairings(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each of n columns meets every other once."""
    ring = list(range(n + n % 2))
    rounds = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], reversed(ring)) if max(a, b) < n]
        rounds.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of factor @ factor.T, by rotations of pairs of columns."""
    a = factor.copy()
    rounds = pairings(a.shape[1])
    for _ in range(sweeps):
        turned = False
        for left, right in rounds:
            p, q = a[:, left], a[:, right]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            act = np.abs(pq) > 2.0 ** -50 * np.sqrt(pp * qq)
            if not act.any():
                continue
            turned = True
            left, right, p, q, pp, qq, pq = left[act], right[act], p[:, act], q[:, act], pp[act], qq[act], pq[act]
            tau = (qq - pp) / (2 * pq)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            a[:, left], a[:, right] = c * p - c * t * q, c * t * p + c * q
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    return norms[falling] ** 2, a[:, falling] / norms[falling]


def _added(parts: DataFrame, keys: list[str]) -> dict[tuple, float]:
    """Sums of task results by place; as many as places, whatever the rows."""
    return {tuple(r[k] for k in keys): r["s"] for r in parts.groupBy(*keys).agg(F.sum("s").alias("s")).collect()}


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column("x"), width)
            # halves of 31 bits keep the sums of a batch inside 64 bits
            total = [t + (int(h) << 31) + int(w) for t, h, w in zip(total, (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0))]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "s"])

    places = vectors.mapInArrow(task, "i int, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))
    found = _added(places, ["i"])
    return int(found.get((-1,), 0)), [int(found.get((i,), 0)) for i in range(width)]


def _scatter(vectors: DataFrame, width: int, rows_of, size: int) -> np.ndarray:
    """Sum of outer products of rows_of(x) over all vectors, and of the rows themselves in a last column."""
    upper = np.triu_indices(size)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, flat = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = rows_of(matrix(batch.column("x"), width))
            total += z.T @ z
            flat += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([upper[0], np.arange(size)]).astype(np.int32)), pa.array(np.concatenate([upper[1], np.full(size, size)]).astype(np.int32)),
            pa.array(np.concatenate([total[upper], flat])),
        ], ["i", "j", "s"])

    out = np.zeros((size, size + 1))
    for (i, j), s in _added(vectors.mapInArrow(task, "i int, j int, s double"), ["i", "j"]).items():
        out[i, j] = s
        if j < size:
            out[j, i] = s
    return out


def covariance(scatter: np.ndarray, remainders: list[int], n: int) -> np.ndarray:
    """Scatter of z over n, less the outer product of what rounding the means left; each entry rounded once where sums are exact."""
    size = len(remainders)
    return np.array([
        [float(Fraction(n * int(scatter[i, j]) - remainders[i] * remainders[j], n * n)) for j in range(size)] for i in range(size)
    ], np.float64).reshape(size, size)


def fit(vectors: DataFrame, width: int, components: int) -> Whitening:
    """Fits a whitening to a table of distinct x vectors (column x, all of the width)."""
    n, sums = _sums(vectors, width)
    model = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    if not n or not width:
        return model
    means = model.means
    v = covariance(_scatter(vectors, width, lambda x: (x - means).astype(np.float64), width)[:, :-1], model.remainders, n)
    factor, order = pivoted_cholesky(v)
    values, columns = one_sided_jacobi(factor)
    places = np.empty(width, int)
    places[order] = np.arange(width)
    leading = columns[places][:, :components]
    signs = np.sign(leading[np.abs(leading).argmax(axis=0), np.arange(leading.shape[1])])
    model.eigenvalues, model.components, model.trace = values[:components], leading * signs, float(np.trace(v))
    if model.eigenvalues.size:
        k = model.eigenvalues.size
        seen = _scatter(vectors, width, model.whitened, k)
        mean = seen[:, -1] / n
        model.identity_error = float(np.abs(seen[:, :-1] / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(embeddings: DataFrame, folder: str, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error, eigenvalue of every usable row and leading component."""
    vector = F.col(vector_col)
    usable = lambda width: embeddings.select(F.col(id_col).cast("long").alias("id"), whole(vector, width).alias("x")).filter("x IS NOT NULL")
    longest = usable(0).select(F.max(F.size("x"))).first()[0] or 0
    rows = usable(longest)
    model = fit(written(rows.select("x").distinct(), folder, "fit"), longest, components)
    k = model.eigenvalues.size
    explained = model.eigenvalues / model.trace if k else np.zeros(0)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = matrix(batch.column("x"), longest)
            count = len(x)
            every = np.repeat(np.arange(count), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1), count).astype(np.int32)),
                pa.array(np.full(count * k, model.n, np.int64)), pa.array(model.deviations(x), pa.int64()).take(pa.array(every)),
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, model.identity_error)),
                pa.array(np.tile(model.eigenvalues, count)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    shape = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    return rows.mapInArrow(task, shape).withColumnRenamed("id", id_col)
