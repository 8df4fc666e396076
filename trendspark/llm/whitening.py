"""Embedding whitening by incremental eigendecomposition.

A spectrum (number of vectors, mean, eigenvalues, eigenvectors of the centred
scatter) takes a vector by one rank-one update, ``A + w * u * u'`` with u the vector
less the mean so far. In the eigenbasis that is a diagonal plus a rank-one term,
whose eigenvalues are the roots of the secular equation

    1 + rho * sum z_j^2 / (d_j - x) = 0,

one between each two neighbouring d. Entries of z that are tiny, and poles that
coincide (rotated into one first), are deflated: their eigenpairs stay. The roots
are found relative to their nearest pole and all at once; z is then recomputed
from them, which keeps the eigenvectors orthogonal.

Each task folds its vectors into one spectrum. Spectra are combined in a tree of
bounded fan-in by successive rank-one updates, one an eigenpair of the smaller and
one for the distance of the means. What rounding has left is removed by a
Rayleigh-Ritz step over the whole basis: projections of all centred vectors give a
d x d matrix, summed over the tasks in a tree too, whose eigenvectors turn the
basis. Only d x d matrices reach the driver.

A rank-one update costs d^3 steps (about 0.5 ms at 64 dimensions). For wide or very
many vectors, ``compress`` replaces a batch by the d rows of its triangular factor,
which has the same scatter, and folds in those.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.session import cut_lineage

EPS = np.finfo(float).eps
FAN_IN = 16
MOST_ROWS = 4096  # of vectors that are unpacked at a time
LONG = 2 ** 63


# ---------------------------------------------------------------- secular equation

def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum z^2 / (d - x) for ascending, distinct d, z without zeros and rho > 0,
    as the index of each root's nearest pole and its distance from that pole."""
    k = len(d)
    z2 = rho * z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    at = np.arange(k)
    half = (upper - d) / 2
    gaps = d - d[:, None]
    f = 1 + (z2 / (gaps - half[:, None])).sum(axis=1)
    right = (f < 0) & (at < k - 1)  # the root lies in the upper half: count from the pole above
    origin = at + right
    delta = d - d[origin][:, None]
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    low, high = np.where(~right & (f < 0), half, low), np.where(~right & (f < 0), upper - d, high)  # last root only
    below = at[None, :] <= at[:, None]
    pole, next_pole = delta[at, at], delta[at, np.minimum(at + 1, k - 1)]
    next_pole[-1] = upper[-1] - d[-1] + z2.sum()
    x = (low + high) / 2
    for _ in range(60):
        gap = delta - x[:, None]
        ratio = z2 / gap
        slope = ratio / gap
        f = 1 + ratio.sum(axis=1)
        done = np.abs(f) <= 4 * EPS * k * (1 + np.abs(ratio).sum(axis=1))
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        if np.all(done | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))):
            break
        # The terms on either side of the root as one pole each, equal in value and slope.
        lower_slope = (slope * below).sum(axis=1)
        upper_slope = slope.sum(axis=1) - lower_slope
        a, b = pole - x, next_pole - x
        c = f - a * lower_slope - b * upper_slope
        p = (a + b) * f - a * b * (lower_slope + upper_slope)
        q = a * b * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        step = np.where(np.isfinite(step), step, 0.0)
        fresh = x + step
        inside = (fresh > low) & (fresh < high) & (step != 0)
        x = np.where(done, x, np.where(inside, fresh, (low + high) / 2))
    return origin, x


def rank_one(d: np.ndarray, basis: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``basis @ (diag(d) + rho * z z') @ basis'``."""
    size = np.linalg.norm(z)
    if not rho * size * size > 0:
        return d, basis
    z, rho = z / size, rho * size * size
    near = 8 * EPS * max(np.abs(d).max(), rho)
    live = rho * np.abs(z) > near
    if live.sum() > 1:
        i = np.nonzero(live)[0]
        cross = np.diff(d[i]) * np.abs(z[i[:-1]] * z[i[1:]]) / (z[i[:-1]] ** 2 + z[i[1:]] ** 2)
        if (cross <= near).any():
            d, basis, z, live = d.copy(), basis.copy(), z.copy(), live.copy()
            last = -1
            for j in i:
                if last >= 0:
                    r = math.hypot(z[last], z[j])
                    c, s = z[j] / r, z[last] / r
                    t = d[j] - d[last]
                    if abs(t * c * s) <= near:  # turn the two so that only the later one takes part
                        z[j], z[last], live[last] = r, 0.0, False
                        basis[:, [last, j]] = basis[:, [last, j]] @ np.array([[c, s], [-s, c]])
                        d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
                last = j
    i = np.nonzero(live)[0]
    if not len(i):
        return d, basis
    i = i[np.argsort(d[i], kind="stable")]
    poles, w = d[i], z[i]
    origin, x = secular_roots(poles, w, rho)
    gap = (poles - poles[origin][:, None]) - x[:, None]  # pole j less root i
    apart = poles - poles[:, None]
    np.fill_diagonal(apart, 1.0)
    fixed = np.sqrt(np.abs((gap / apart).prod(axis=0)))  # the z that has exactly these roots
    vectors = np.copysign(fixed, w) / gap  # row i: root i
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    out, values = basis.copy(), d.copy()
    out[:, i] = basis[:, i] @ vectors.T
    values[i] = poles[origin] + x
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


# ---------------------------------------------------------------- spectra

class Spectrum:
    """Number, mean, eigenvalues (ascending) and eigenvectors of the centred scatter of vectors."""

    def __init__(self, dim: int, packed: bytes | None = None):
        if packed is None:
            self.n, self.mean, self.values, self.basis = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)
        else:
            flat = np.frombuffer(packed)
            self.n, self.mean, self.values = int(flat[0]), flat[1:dim + 1], flat[dim + 1:2 * dim + 1]
            self.basis = flat[2 * dim + 1:].reshape(dim, dim)

    def packed(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.values, self.basis.ravel()]).tobytes()

    def turn(self, u: np.ndarray, rho: float) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, self.basis.T @ u, rho)

    def shift(self, mean: np.ndarray, n: int) -> None:
        """The part of ``n`` more vectors that lies between the two means."""
        both, u = self.n + n, mean - self.mean
        self.turn(u, self.n * n / both)
        self.mean, self.n = self.mean + u * (n / both), both

    def fold(self, rows: np.ndarray, compress: bool) -> None:
        if compress and len(rows) > rows.shape[1]:
            mean = rows.mean(axis=0)
            for r in np.linalg.qr(rows - mean, mode="r"):
                self.turn(r, 1.0)
            self.shift(mean, len(rows))
            return
        for x in rows:
            self.shift(x, 1)

    def add(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.turn(vector, float(value))
        self.shift(other.mean, other.n)


def merged_spectra(dim: int) -> Callable[[list[bytes]], bytes]:
    def merge(blobs: list[bytes]) -> bytes:
        first, *others = sorted((Spectrum(dim, b) for b in blobs), key=lambda s: -s.n)
        for other in others:
            first.add(other)
        return first.packed()
    return merge


def summed(blobs: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(b) for b in blobs], axis=0).tobytes()


def per_task(vectors: DataFrame, dim: int, start: Callable, step: Callable, end: Callable) -> DataFrame:
    """``part``, ``blob``: one row a task that has vectors, folded batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, any_row = start(), False
        for batch in batches:
            for rows in unpacked(batch.column(0), dim):
                state, any_row = step(state, rows), True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([end(state)], pa.binary())], names=["part", "blob"])

    return vectors.mapInArrow(run, "part long, blob binary")


def in_tree(parts: DataFrame, merge: Callable[[list[bytes]], bytes], name: str) -> bytes:
    """The merged blob of all parts, ``FAN_IN`` at a time; only the last comes to the driver."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table.sort_by("part")["blob"].to_pylist()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([merge(blobs)], pa.binary())})

    parts = cut_lineage(parts, name)
    while (top := parts.agg(F.max("part")).first()[0]) > 0:
        parts = cut_lineage(parts.select(F.expr(f"part div {FAN_IN}").alias("up"), "part", "blob")
                            .groupBy("up").applyInArrow(run, "part long, blob binary"), name)
    return parts.first()["blob"]


# ---------------------------------------------------------------- vectors

def quantised(table: DataFrame, carry: list[str] | None = None, vector_col: str = "embedding", steps: int = 256) -> DataFrame:
    """``row`` (struct of the carried columns, all by default, so no name clashes) and ``x``, the
    entries times ``steps`` rounded down. Rows whose vector is null, empty or holds a null or
    non-finite entry (or one beyond a long) are left out."""
    carry = table.columns if carry is None else carry
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & (F.abs(c * float(steps)) < float(LONG)))
    return table.where((F.size(v) > 0) & whole).select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                                                        F.transform(v, lambda c: F.floor(c * float(steps))).alias("x"))


def unpacked(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), MOST_ROWS):
        yield column.slice(at, MOST_ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Centre:
    """Exact number and sums of the fit list; differences from its mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        if max(np.abs(x).max(initial=0), np.abs(self.whole).max()) >= LONG // 4 or (x == -LONG).any():
            return x.astype(float) - self.whole.astype(float) - self.part
        return (x - self.whole).astype(float) - self.part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n * x - sums)^2, on integers."""
        largest = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums))
        if largest * largest * x.shape[1] < LONG:
            return pa.array(((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        from decimal import Decimal

        exact = ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def centre_of(fit: DataFrame, dim: int) -> Centre:
    """One small row a dimension and task, summed exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        n, high, low = 0, [0] * dim, [0] * dim
        for batch in batches:
            for rows in unpacked(batch.column(0), dim):
                n += len(rows)  # 4,096 halves of a long can't overflow
                high = [a + int(b) for a, b in zip(high, (rows >> 32).sum(axis=0))]
                low = [a + int(b) for a, b in zip(low, (rows & 0xFFFFFFFF).sum(axis=0))]
        if n:
            sums = [Decimal((a << 32) + b) for a, b in zip(high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                                              pa.array(sums, pa.decimal128(38, 0))], names=["dim", "n", "total"])

    rows = fit.mapInArrow(run, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    return Centre(rows[0]["n"], [int(r["total"]) for r in sorted(rows)])


# ---------------------------------------------------------------- whitening

class Whitening:
    """Centre, eigenvalues (falling, of the covariance with divisor n) and eigenvectors as columns."""

    def __init__(self, centre: Centre, values: np.ndarray, basis: np.ndarray, trace: float):
        self.centre, self.values, self.basis, self.trace = centre, values, basis, trace

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.basis / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, dim: int, most: int | None = None, compress: bool = False) -> Whitening:
    """From a table of distinct vectors ``x``: spectra of the tasks, combined, then refined.
    Components with no spread are left out; an eigenvector's largest entry is positive."""
    centre = centre_of(fit, dim)

    def fold(spectrum: Spectrum, rows: np.ndarray) -> Spectrum:
        spectrum.fold(rows.astype(float), compress)
        return spectrum

    parts = per_task(fit, dim, lambda: Spectrum(dim), fold, lambda s: s.packed())
    basis, _ = np.linalg.qr(Spectrum(dim, in_tree(parts, merged_spectra(dim), "spectra")).basis)

    def project(total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        y = centre.centred(rows) @ basis
        return total + y.T @ y

    parts = per_task(fit, dim, lambda: np.zeros((dim, dim)), project, lambda m: m.tobytes())
    ritz = np.frombuffer(in_tree(parts, summed, "projections")).reshape(dim, dim) / centre.n
    values, turned = np.linalg.eigh(ritz)
    values, vectors, trace = values[::-1], (basis @ turned)[:, ::-1], float(np.trace(ritz))
    k = min(most or dim, int((values > dim * EPS * trace).sum()))
    vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)[:k]
    return Whitening(centre, values[:k], vectors, trace)


def identity_error(fit: DataFrame, dim: int, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(whitening.values)

    def add(total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w = whitening.apply(rows)
        return total + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    parts = per_task(fit, dim, lambda: np.zeros(k + k * k), add, lambda m: m.tobytes())
    total = np.frombuffer(in_tree(parts, summed, "whitened")) / whitening.centre.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def whiten(rows: DataFrame, most: int | None = None, compress: bool = False) -> DataFrame:
    """The rows of ``quantised`` on each of the first ``most`` components: ``row``, ``component`` (from
    1), ``n`` (distinct vectors), ``deviation`` (decimal, sum of (n * x - S)^2), ``whitened``,
    ``explained`` and ``identity_error``.

    The fit list holds every distinct vector once, so repeated rows don't weigh
    more; they get equal results. Vectors of another length than most rows have
    (of equally frequent lengths the longest counts) are left out. Components
    without spread (all, for a single distinct vector) give no rows; so does an empty table.
    """
    schema = T.StructType([rows.schema["row"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.DecimalType(38, 0)), *(
        T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return rows.sparkSession.createDataFrame([], schema)
    dim = lengths[0]["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = cut_lineage(rows.select("x").distinct(), "fit")
    whitening = fit_whitening(fit, dim, most, compress)
    k = len(whitening.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(fit, dim, whitening), whitening.values / whitening.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in unpacked(batch.column(1), dim):
                each = pa.array(np.repeat(np.arange(at, at + len(x)), k))
                own = pa.array(np.repeat(np.arange(len(x)), k))
                at, size = at + len(x), len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(size, whitening.centre.n)), whitening.centre.deviation(x).take(own),
                     pa.array(whitening.apply(x).ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(size, error))], names=schema.names)

    return rows.select("row", "x").mapInArrow(run, schema)
