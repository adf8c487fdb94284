"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps the spectrum of the scatter of the rows it has seen: row by row, the centred row is a rank-one update
of a diagonal matrix, whose new eigenvalues are the roots of a secular equation and whose vectors follow from them.
Components that the row does not touch, and equal eigenvalues after a turn, are left out of the equation
(deflation). Spectra of tasks are put together in a tree, each by successive rank-one updates with the other's scaled
vectors and one with the difference of the means. At last a Rayleigh-Ritz step over all rows refines it: the
covariance in the basis found is summed up by all tasks, and its small eigenproblem turns the basis.

Entries c become whole numbers x = floor(64 * c) + 1000000 in double arithmetic; counts and sums are exact. A spectrum
has dimension squared entries; nothing larger goes through one task or the driver.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are dropped; so are those of another
length than most have (of equal counts the smaller length); entries beyond the range of whole numbers fail openly.
Directions without variance have no whitened value and no component; one row or none gives an empty result.
Repeated rows and ids count each; rows with a null id stay; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.session import materialize

EPS = np.finfo(float).eps
SHIFT = 1_000_000
#: Spectra put together in one task.
FAN_IN = 16


def whole(column: Column) -> Column:
    """The vector of whole numbers; null where the row takes no part."""
    entries = F.transform(column, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(entries, lambda c: F.floor(c * 64.0).cast("long") + SHIFT)
    return F.when(~bad & (F.size(column) > 0), x)


@np.errstate(all="ignore")
def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - root) = 0 for rising d, one in each gap and one above.

    Returns the roots and the matrix d[i] - root[j], both to nearly full relative precision: a root is kept as
    its distance from the nearer pole.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    if n == 1:
        return d + z2, np.array([[-z2[0]]])
    # Which half holds the root: the sign at the middle.
    near = d[:, None] - d[None, :]
    middle = (z2[:, None] / (near - gap / 2)).sum(axis=0) + 1
    right = middle <= 0
    right[-1] = False
    at = np.arange(n) + right
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    near = d[:, None] - d[None, at]
    k = np.arange(n)
    below = np.where(k[:, None] <= k[None, :], z2[:, None], 0.0)
    above = np.minimum(k + 1, n - 1)
    # A first guess: the two poles at the ends of the gap, the others as they stand at its middle.
    above_z2 = np.append(z2[1:], 0.0)
    c = middle + 2 * (z2 - above_z2) / gap
    a = c * gap + z2 + above_z2
    root = np.sqrt(np.maximum(a * a - 4 * z2 * gap * c, 0))
    x = np.where(a > 0, 2 * z2 * gap / (a + root), (a - root) / (2 * c)) - right * gap
    x = np.where((x > low) & (x < high), x, (low + high) / 2)
    for _ in range(80):
        apart = near - x
        inverse = 1 / apart
        psi = np.einsum("ij,ij->j", below, inverse)
        w = z2 @ inverse
        # Terms of poles below the root are negative, those of poles above it positive.
        size = 1 + w - 2 * psi
        w += 1
        high = np.where(w > 0, x, high)
        low = np.where(w > 0, low, x)
        done = (np.abs(w) <= 32 * EPS * size) | (high - low <= 2 * EPS * np.abs(x))
        if done.all():
            break
        # Rational step with the two poles at the ends of the gap; the last root has one.
        inverse *= inverse
        slope = z2 @ inverse
        psi = np.einsum("ij,ij->j", below, inverse)
        left, next_ = apart[k, k], apart[above, k]
        both = left * next_
        c = w - left * psi - next_ * (slope - psi)
        a = (left + next_) * w - both * slope
        root = np.sqrt(np.maximum(a * a - 4 * both * w * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * both * w / (a + root))
        # One pole: c + s / (left - step), with the slope of now.
        s = left[-1] * left[-1] * slope[-1]
        rest = w[-1] - s / left[-1]
        step[-1] = left[-1] + s / rest if rest > 0 else np.nan
        step = np.where(w * step >= 0, -w / slope, step)
        new = x + step
        inside = (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return d[at] + x, near - x


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising values, vectors as columns) of u diag(d) u' + v v'."""
    z = v @ u
    norm = float(z @ z)
    if norm == 0:
        return d, u
    tolerance = 8 * EPS * (max(d[-1], 0.0) + norm)
    # Equal values: a turn within their plane leaves all of v to one of them.
    close = np.flatnonzero(np.diff(d) <= tolerance)
    if len(close):
        u = u.copy()
        for i in close.tolist():
            r = float(np.hypot(z[i], z[i + 1]))
            if r > 0:
                c, s = z[i + 1] / r, z[i] / r
                one, two = u[:, i].copy(), u[:, i + 1].copy()
                u[:, i], u[:, i + 1] = c * one - s * two, s * one + c * two
                z[i], z[i + 1] = 0.0, r
    active = np.flatnonzero(z * z * norm > (tolerance * EPS) * norm)
    active = active[np.abs(z[active]) * np.sqrt(norm) > tolerance]
    if not len(active):
        return d, u
    da, za = d[active], z[active]
    # A turn leaves values within the tolerance of each other only where one of them is left out.
    roots, apart = secular_roots(da, za * za)
    # The vector for which the roots are exact, so that the eigenvectors are orthogonal.
    n = len(da)
    between = da[:, None] - da[None, :]
    np.fill_diagonal(between, 1.0)
    exact = np.abs(np.prod(apart / between, axis=1))
    exact = np.sqrt(exact) * np.sign(za)
    vectors = exact[:, None] / apart
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    if n == len(d):
        return roots, u @ vectors
    d = d.copy()
    d[active] = roots
    u = u.copy()
    u[:, active] = u[:, active] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """Count, exact sums and spectrum of the scatter of rows."""

    def __init__(self, size: int):
        self.n = 0
        self.sums = np.zeros(size, np.int64)
        self.d = np.zeros(size)
        self.u = np.eye(size)

    def add(self, x: np.ndarray) -> None:
        """One row: the update has the weight n / (n + 1), around the mean before it."""
        n = self.n
        if n:
            centred = (n * x - self.sums) / n
            self.d, self.u = rank_one(self.d, self.u, centred * np.sqrt(n / (n + 1)))
        self.n = n + 1
        self.sums = self.sums + x

    def merge(self, n: int, sums: np.ndarray, d: np.ndarray, u: np.ndarray) -> None:
        """Another spectrum, by rank-one updates; it had rows."""
        if self.n:
            for value, vector in zip(d, u.T):
                if value > 0:
                    self.d, self.u = rank_one(self.d, self.u, vector * np.sqrt(value))
            apart = sums / n - self.sums / self.n
            weight = np.sqrt(self.n / (self.n + n) * n)
            self.d, self.u = rank_one(self.d, self.u, apart * weight)
        else:
            self.d, self.u = d.copy(), u.copy()
        self.n += n
        self.sums = self.sums + sums

    def row(self) -> dict:
        return {
            "n": [self.n],
            "sums": [self.sums.tolist()],
            "d": [self.d.tolist()],
            "u": [self.u.ravel().tolist()],
        }


STATE = "n long, sums array<long>, d array<double>, u array<double>"
_STATE = pa.schema(
    [("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("d", pa.list_(pa.float64())), ("u", pa.list_(pa.float64()))]
)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def spectra(vectors: DataFrame, size: int) -> DataFrame:
    """One spectrum for each task, put together in a tree until one is left (none for no rows)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum(size)
        for batch in batches:
            for x in matrix(batch.column(0), size):
                state.add(x)
        if state.n:
            yield pa.RecordBatch.from_pydict(state.row(), _STATE)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum(size)
        for batch in batches:
            for row in batch.select(["n", "sums", "d", "u"]).to_pylist():
                state.merge(row["n"], np.array(row["sums"]), np.array(row["d"]), np.reshape(row["u"], (size, size)))
        if state.n:
            yield pa.RecordBatch.from_pydict(state.row(), _STATE)

    found = materialize(vectors.select("x").mapInArrow(grow, STATE), "spectra")
    while (left := found.count()) > 1:
        parts = -(-left // FAN_IN)
        dealt = found.repartition(parts, F.hash("sums")) if parts > 1 else found.coalesce(1)
        found = materialize(dealt.mapInArrow(join, STATE), "spectra")
    return found


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n; the numerator is exact."""
    return (n * x - sums) / n


def _second_moment(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of all rows in a basis; cells are summed by Spark, as many as the basis has vectors, squared."""
    size, rank = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            y = _centred(matrix(batch.column(0), size), n, sums) @ basis
            total += y.T @ y
        cells = pa.array(np.arange(rank * rank), pa.int64())
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], ["cell", "value"])

    cells = vectors.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value"))
    out = np.zeros(rank * rank)
    for cell, value in cells.toLocalIterator():
        out[cell] = value / n
    return out.reshape(rank, rank)


def whiten(
    rows: DataFrame, most: int = 32, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for the ``most`` first components."""
    spark = rows.sparkSession
    x = rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector)).alias("x")).filter("x is not null")
    x = materialize(x, "whole-vectors")
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], shape)
    size = lengths[0]["size"]
    x = x.filter(F.size("x") == size)
    state = spectra(x, size).collect()[0]
    n, sums = state["n"], np.array(state["sums"], np.int64)
    start = np.reshape(state["u"], (size, size))
    small = _second_moment(x, n, sums, start)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    trace = float(values.sum())
    order = [i for i in range(size - 1, -1, -1) if values[i] > 64 * size * EPS * trace][:most]
    if not order:
        return spark.createDataFrame([], shape)
    values, basis = values[order], (start @ turn)[:, order]
    # Turned and rounded vectors, made unit again.
    basis /= np.sqrt((basis * basis).sum(axis=0))
    scaled = basis / np.sqrt(values)
    explained = values / trace
    error = float(np.abs(_second_moment(x, n, sums, scaled) - np.eye(len(order))).max())
    rank = len(order)
    # Beyond this, squares of whole numbers no longer fit; then they are summed as Python's.
    fits = 2**62 // size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                apart = n * matrix(part.column(1), size) - sums
                largest = int(np.abs(apart).max())
                if largest * largest > fits:
                    apart = apart.astype(object)
                away = (apart * apart).sum(axis=1).tolist()
                white = (apart.astype(float) / n) @ scaled
                count = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(count), rank))),
                        pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * rank, n)),
                        pa.array(away, pa.int64()).take(pa.array(np.repeat(np.arange(count), rank))),
                        pa.array(white.ravel()),
                        pa.array(np.tile(explained, count)),
                        pa.array(np.full(count * rank, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(run, shape)
