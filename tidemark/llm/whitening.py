"""Embedding whitening by incremental eigendecomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .vectors import finite, matrix, whole

EPS = np.finfo(np.float64).eps
#: Spectra that one task combines in a round.
FAN = 8
#: Vectors that a partition updates its spectrum by, on average: half a millisecond each at 64 dimensions.
SHARE = 4096
#: Steps of the root finder; it takes some eight.
STEPS = 80
#: Entries below this in size.
MOST = 1 << 40


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(weights / (poles - y)), one right of each pole (ascending, all different; weights positive): the
    number of the pole nearest to each root, and the root's distance from it, which keeps its digits.

    All roots at once: each is bracketed, and found by interpolation with a rational function that has the two poles around it;
    a step that leaves the bracket is replaced by its middle."""
    m = len(poles)
    k = np.arange(m)
    total = weights.sum()
    right = np.append(poles[1:], poles[-1] + 2 * total)
    width = np.append(np.diff(poles), total)
    # the sign in the middle tells which pole is nearer
    middle = 1 + (weights / ((poles - poles[:, None]) - width[:, None] / 2)).sum(axis=1)
    left_half = (middle >= 0) | (k == m - 1)
    origin = np.where(left_half, k, k + 1)
    lo, hi = np.where(left_half, 0, -width / 2), np.where(left_half, width / 2, 0)
    hi[-1] = width[-1]
    base = poles[origin]
    shifted = poles - base[:, None]
    one, two = poles - base, right - base
    below = k[None, :] <= k[:, None]
    y = (lo + hi) / 2
    for _ in range(STEPS):
        gap = shifted - y[:, None]
        term = weights / gap
        slope = term / gap
        f = 1 + term.sum(axis=1)
        size = 1 + np.abs(term).sum(axis=1)
        if (done := (np.abs(f) <= 4 * EPS * size) | (hi - lo <= 2 * EPS * np.abs(y))).all():
            break
        lo, hi = np.where(f < 0, y, lo), np.where(f < 0, hi, y)
        psi = np.where(below, slope, 0).sum(axis=1)
        phi = slope.sum(axis=1) - psi
        d1, d2 = one - y, two - y
        a = (d1 + d2) * f - d1 * d2 * (psi + phi)
        b = d1 * d2 * f
        c = f - d1 * psi - d2 * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = y + step
        inside = np.isfinite(new) & (new > lo) & (new < hi)
        y = np.where(done, y, np.where(inside, new, (lo + hi) / 2))
    return origin, y


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending) of a matrix with the given one after weight * v v' was added.

    Deflation: of equal eigenvalues all but one are turned away from v, and directions that v hardly has stay as they are. The
    rest follows from the secular equation; eigenvectors come from weights that fit the computed roots exactly, which
    keeps them orthogonal."""
    z = vectors.T @ v
    norm = float(z @ z)
    if weight * norm <= 0:
        return values, vectors
    vectors = vectors.copy()
    tolerance = 8 * EPS * max(float(np.abs(values).max()), weight * norm)
    close = np.flatnonzero(np.diff(values) <= tolerance)
    if len(close):
        for run in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
            s = slice(run[0], run[-1] + 2)
            length = float(np.sqrt(z[s] @ z[s]))
            if length == 0:
                continue
            mirror = z[s].copy()
            sign = 1.0 if mirror[-1] >= 0 else -1.0
            mirror[-1] += sign * length
            mirror /= np.sqrt(mirror @ mirror)
            vectors[:, s] -= 2 * np.outer(vectors[:, s] @ mirror, mirror)
            z[s] = 0
            z[run[-1] + 1] = -sign * length
    active = np.flatnonzero(weight * np.abs(z) * np.sqrt(norm) > tolerance)
    poles = values[active]
    if not len(active):
        return values, vectors
    origin, y = secular_roots(poles, weight * z[active] ** 2)
    away = (poles - poles[origin][:, None]) - y[:, None]  # pole j less root i
    apart = poles[None, :] - poles[:, None]  # pole j less pole i
    np.fill_diagonal(apart, -1.0)
    fitted = np.sqrt(np.abs(np.prod(away / apart, axis=0))) * np.where(z[active] < 0, -1.0, 1.0)
    turn = (fitted / away).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    vectors[:, active] = vectors[:, active] @ turn
    values = values.copy()
    values[active] = poles[origin] + y
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Eigenvalues and eigenvectors of the centred scatter of n points, with their mean."""

    def __init__(self, dims: int, n: int = 0, mean=None, values=None, vectors=None):
        self.n = n
        self.mean = np.zeros(dims) if mean is None else np.asarray(mean)
        self.values = np.zeros(dims) if values is None else np.asarray(values)
        self.vectors = np.eye(dims) if vectors is None else np.asarray(vectors).reshape(dims, dims)

    def add(self, x: np.ndarray) -> None:
        """One more point: its distance from the mean is one centred update."""
        away = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.mean = self.mean + away / (self.n + 1)
        self.n += 1

    def combine(self, other: Spectrum) -> None:
        """Another set of points: one update for each of its eigenvectors, and one for the distance of the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        both = self.n + other.n
        away = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / both)
        self.mean = self.mean + away * (other.n / both)
        self.n = both


SPECTRUM = "id long, n long, mean array<double>, values array<double>, vectors array<double>"
SPECTRUM_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("mean", "values", "vectors"))])


def spectrum_row(number: int, s: Spectrum) -> list[pa.Array]:
    return [pa.array([number], pa.int64()), pa.array([s.n], pa.int64()), *(pa.array([x.reshape(-1).tolist()], pa.list_(pa.float64())) for x in (s.mean, s.values, s.vectors))]


def spectrum_of(fit: DataFrame, rows: int, dims: int, origin: np.ndarray) -> Spectrum:
    """The spectrum of the table fit (x array<long>, so many rows), less origin: by partition, then combined FAN at a time."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dims)
        for rows in lean(batches):
            for x in (matrix(rows.column("x"), dims) - origin).astype(np.float64):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_arrays(spectrum_row(TaskContext.get().partitionId(), own), schema=SPECTRUM_ARROW)

    def combined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        whole_of = [Spectrum(dims, *(r[c] for c in ("n", "mean", "values", "vectors"))) for r in rows]
        for other in whole_of[1:]:
            whole_of[0].combine(other)
        return pa.Table.from_arrays(spectrum_row(rows[0]["id"] // FAN, whole_of[0]), schema=SPECTRUM_ARROW)

    dealt = fit.repartition(-(-rows // SHARE), F.xxhash64("x"))
    parts = written(dealt.mapInArrow(partial, SPECTRUM), "whiten-spectra")
    while parts.count() > 1:
        parts = written(parts.groupBy(F.floor(F.col("id") / FAN)).applyInArrow(combined, SPECTRUM), "whiten-spectra")
    row = parts.first()
    return Spectrum(dims, row["n"], row["mean"], row["values"], row["vectors"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: in longs if they hold it, else in Python's whole numbers."""
    if n * (1 + int(np.abs(x).max(initial=0))) * 2 < 2**63:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def moments(rows: DataFrame, dims: int, outer) -> np.ndarray:
    """The sum of outer(x) over the table rows (x array<long>), as an array: each task sums its own, and places are summed by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in lean(batches):
            here = outer(matrix(batch.column("x"), dims)).reshape(-1)
            total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

    kind = "long" if outer(np.zeros((0, dims), np.int64)).dtype == np.int64 else "double"
    found = rows.mapInArrow(partial, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return np.array([r["value"] for r in found])


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error), a row for each vector that counts; whitened and explained are
    arrays, a place for each of the first `components` components by falling eigenvalue.

    Vectors count that are neither null nor hold null or non-finite entries. An entry c is x = floor(scale * c) + offset. Covariances are
    over the n different x vectors, divisor n. deviation: the sum over dimensions of (n * x - sum)^2, exactly.

    Each partition of the different vectors is decomposed by centred rank-one updates (secular equation, deflation), spectra of
    partitions are combined by such updates in rounds, and the basis so found is refined by Rayleigh-Ritz: the covariance in
    that basis is summed over the cluster, from exactly centred vectors, and its own eigenvectors turn the basis. The
    driver sees dims * dims numbers, whatever the rows.

    The table's dimension is that of most of its vectors (of equally many the smaller one); vectors of another one don't count, nor
    do empty ones. Components without variance have whitened 0 and no part in identity_error; without any variance explained
    is 0. A deviation beyond long is null. An entry of 2**40 or more in size ends the query with an error. Repeated rows
    and null ids are rows of their own. No vectors give an empty result; other columns are ignored."""
    every = vectors.where(finite(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), vector)
    common = every.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 0
    x = every.where(F.size(vector) == dims).select("vec_id", whole(vector, scale, MOST, offset).alias("x"))
    out = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if not dims:
        return x.where(F.lit(False)).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in out.split(", ")[1:])))
    fit = written(x.select("x").distinct(), "whiten-fit")
    n = fit.count()
    sums = moments(fit, dims, lambda a: a.sum(axis=0))
    basis = np.linalg.qr(spectrum_of(fit, n, dims, np.array([int(s) // n for s in sums], np.int64)).vectors)[0]

    def inner(a: np.ndarray) -> np.ndarray:
        y = (centred(a, n, sums) / n).astype(np.float64) @ basis
        return y.T @ y

    values, turn = np.linalg.eigh(moments(fit, dims, inner).reshape(dims, dims) / n)
    trace = float(values.sum())
    first = np.argsort(-values, kind="stable")[:components]
    values = np.where(values[first] > dims * EPS * max(trace, 0.0), values[first], 0.0)
    with np.errstate(divide="ignore"):
        axes = (basis @ turn)[:, first] * np.where(values > 0, 1 / np.sqrt(values), 0.0)
    explained = (values / trace if trace > 0 else np.zeros(len(values))).tolist()

    def white(a: np.ndarray) -> np.ndarray:
        return (centred(a, n, sums) / n).astype(np.float64) @ axes

    found = moments(fit, dims, lambda a: (w := white(a)).T @ w).reshape(len(values), -1) / n
    with_variance = values > 0
    error = float(np.abs(found - np.eye(len(values)))[np.ix_(with_variance, with_variance)].max(initial=0.0))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in lean(batches):
            a = matrix(rows.column("x"), dims)
            away = centred(a, n, sums)
            small = dims * float(np.abs(away).max(initial=0)) ** 2 < 2**62
            exact = (away * away).sum(axis=1).tolist() if small else [sum(int(d) ** 2 for d in r) for r in away]
            size = len(a)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * len(values)), pa.array(v)) for v in (white(a).reshape(-1), np.tile(explained, size).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), pa.array([n] * size, pa.int64()), pa.array([d if d < 2**63 else None for d in exact], pa.int64()), *lists, pa.array([error] * size, pa.float64())],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(told, out)
