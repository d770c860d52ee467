"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the spectrum of its scatter matrix and takes in one vector after another, centred on the mean so far: a
rank-one update, whose eigenvalues are the roots of the secular equation between the old ones. Directions that the vector does not touch and
equal eigenvalues are deflated. The spectra of the partitions meet in a tree, each taken in as as many rank-one updates as it has eigenpairs,
and one more for the difference of the means. The basis that comes out is refined once over all rows (Rayleigh-Ritz): the covariance in that
basis, summed over the partitions, is nearly diagonal, and its eigenvectors make the basis exact to double precision.

Entries become whole numbers (floor of 64 times the entry, plus 1,000,000), so sums are exact and the fit does not depend on how rows are
dealt but for rounding. Time for a row grows with the cube of the dimension; memory of a task and of the driver is a few matrices of the
dimension squared.

Nulls, ties and odd rows: vectors that are null, empty, or hold null, NaN, infinite entries or entries of 2**40 and more are dropped, and so are
vectors that have not the length that most have (of two such lengths the larger). Equal vectors count each; they are taken in as one
weighted update where they meet in a batch. Null and repeated ids stay, each row for itself. Components whose eigenvalue is no more than rounding
(all of them where fewer than two different vectors remain) are not returned. Of the two signs of a component, the one whose
largest entry is positive. A deviation beyond the range of a long is null in `deviation` and whole in `deviation_wide`. An empty table gives no rows. Further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import mapped, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries from here on count as not finite.
LARGEST = float(2**40)
#: Spectra that meet in one step of the tree.
FAN = 16
EPS = np.finfo(float).eps


# --- one update ---------------------------------------------------------------------------------------------------------


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum of w / (d - x), one above each pole d; d rises strictly, w > 0. Returns the roots and, for each root (row), every pole less the root.

    The differences are exact to rounding: a root is sought from the nearer pole. Steps fit one pole on either side; those that leave the bracket are halved.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + w.sum())
    half = (upper - d) / 2
    above = 1 + (w / (d - (d + half)[:, None])).sum(axis=1) < 0  # the root is in the upper half
    far = above.copy()
    far[-1] = False  # no pole above the last root
    start = np.where(far, upper, d)
    poles = d - start[:, None]
    low, high = np.where(far, -half, np.where(above, half, 0.0)), np.where(far, 0.0, np.where(above, 2 * half, half))
    x = (low + high) / 2
    ones, left, near, other = _shape(n)
    live, found = np.arange(n), x.copy()  # roots still sought
    for _ in range(100):
        k = np.arange(len(live))
        gap = poles - x[:, None]
        t = w / gap
        f, below = 1 + t @ ones, np.einsum("ij,ij->i", t, left)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        t /= gap
        whole, part = t @ ones, np.einsum("ij,ij->i", t, left)
        a, b = gap[k, near], gap[k, other]
        with np.errstate(all="ignore"):
            c = f - a * part - b * (whole - part)
            p, q = (a + b) * f - a * b * whole, a * b * f
            root = np.sqrt(np.abs(p * p - 4 * q * c))
            root[live == n - 1] *= -1
            new = x + np.where(p * np.sign(root) <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        more = (np.abs(f) > 4 * EPS * (n + np.abs(f - 2 * below) + np.abs(x) * whole)) & (np.nextafter(low, high) < high)
        if not more.all():
            found[live[~more]] = x[~more]
            if not more.any():
                break
            live, poles, left, near, other, low, high, new = live[more], poles[more], left[more], near[more], other[more], low[more], high[more], new[more]
        x = new
    else:
        found[live] = x
    return start + found, (d - start[:, None]) - found[:, None]


_SHAPES: dict[int, tuple] = {}


def _shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For n roots: ones; which poles count as below each root (of the last, all but the last one); the two poles that a step fits."""
    if n not in _SHAPES:
        left, near = np.tri(n), np.arange(n)
        left[-1, -1] = 0.0
        near[-1] = max(n - 2, 0)
        _SHAPES[n] = np.ones(n), left, near, np.minimum(near + 1, n - 1)
    return _SHAPES[n]


def updated(e: np.ndarray, u: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of u diag(e) u' + weight v v'; e rises, columns of u belong to it. weight > 0."""
    z = u.T @ v
    size = weight * float(z @ z)
    if size == 0.0:
        return e, u
    tol = 8 * EPS * (max(float(e[-1]), 0.0) + size)
    close = np.diff(e) <= tol
    if close.any():  # equal eigenvalues: turn their space so that one direction has all of v
        u, z, k = u.copy(), z.copy(), 0
        while k < len(e) - 1:
            last = k
            while last + 1 < len(e) and e[last + 1] - e[k] <= tol:
                last += 1
            if last > k:
                part = z[k : last + 1].copy()
                norm = float(np.sqrt(part @ part))
                if norm > 0:
                    h = part.copy()
                    h[-1] += norm if part[-1] >= 0 else -norm
                    u[:, k : last + 1] -= np.outer(u[:, k : last + 1] @ h, h * (2 / float(h @ h)))
                    z[k:last], z[last] = 0.0, -norm if part[-1] >= 0 else norm
            k = last + 1
    live = np.flatnonzero(weight * np.abs(z) * np.sqrt(size / weight) > tol)
    if not len(live):
        return e, u
    whole = len(live) == len(e)
    d, part = (e, z) if whole else (e[live], z[live])
    roots, gap = secular_roots(d, weight * part * part)
    # the weights for which these roots are exact, so that the directions are at right angles
    n = len(d)
    ratio = np.abs(gap)
    other = np.where(_shape(n)[1][: n - 1] > 0, d[1:, None], d[: n - 1, None])  # each root is set against the pole beside it that is further from the column's
    ratio[: n - 1] /= np.abs(other - d)
    exact = np.copysign(np.sqrt(ratio.prod(axis=0)), part)
    q = exact / gap
    q /= np.sqrt((q * q).sum(axis=1))[:, None]
    if whole:
        return roots, u @ q.T
    e, u = e.copy(), u.copy()
    e[live], u[:, live] = roots, u[:, live] @ q.T
    order = np.argsort(e, kind="stable")
    return e[order], u[:, order]


class Spectrum:
    """Rows taken in, their mean, exact sums, and the spectrum of their scatter matrix."""

    def __init__(self, n: int, total: np.ndarray, e: np.ndarray | None = None, u: np.ndarray | None = None):
        d = len(total)
        self.n, self.total = n, total
        self.mean = total / max(n, 1)
        self.e, self.u = (np.zeros(d), np.eye(d)) if e is None else (e, u)

    def add(self, row: np.ndarray, times: int) -> None:
        """Take in a row that stands so many times."""
        away = row - self.mean
        both = self.n + times
        if self.n:
            self.e, self.u = updated(self.e, self.u, away, self.n * times / both)
        self.mean = self.mean + away * (times / both)
        self.n = both

    def join(self, other: Spectrum) -> None:
        """Take in another spectrum."""
        if not other.n:
            return
        if not self.n:
            self.n, self.total, self.mean, self.e, self.u = other.n, other.total, other.mean, other.e, other.u
            return
        self.e, self.u = updated(self.e, self.u, other.mean - self.mean, self.n * other.n / (self.n + other.n))
        for size, direction in zip(other.e, other.u.T, strict=True):
            if size > 0:
                self.e, self.u = updated(self.e, self.u, direction, float(size))
        self.n, self.total = self.n + other.n, self.total + other.total
        self.mean = self.total / self.n


# --- over partitions ----------------------------------------------------------------------------------------------------


def kept(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """id, vec: rows whose vector has only finite entries."""

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)

    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.filter((F.size("vec") > 0) & F.coalesce(F.forall("vec", finite), F.lit(False)))


def whole_numbers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The batch's vectors as whole numbers less SHIFT."""
    entries = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, dim)


def in_tree(parts: DataFrame, join: Callable[[list], dict]) -> dict | None:
    """Rows with a key from 0 up, FAN at a time made one by join, until one row is left, which comes to the driver."""
    parts = written(parts, "parts")
    last = parts.agg(F.max("key")).first()[0]
    if last is None:
        return None

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        return pd.DataFrame([{"key": int(rows["key"].iloc[0]) // FAN, **join(rows.to_dict("records"))}])

    while last > 0:
        parts, last = parts.groupBy(F.expr(f"key div {FAN}")).applyInPandas(one, parts.schema), last // FAN
    return parts.first().asDict()


def spectra(rows: DataFrame, dim: int) -> Spectrum | None:
    """The spectrum of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, total = Spectrum(0, np.zeros(dim, np.int64)), np.zeros(dim, np.int64)
        for batch in batches:
            x = whole_numbers(batch, dim)
            total += x.sum(axis=0)
            for row, times in zip(*np.unique(x, axis=0, return_counts=True), strict=True):
                own.add(row, int(times))
        if own.n:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.n], pa.int64()), *(pa.array([a.ravel()], pa.list_(t)) for a, t in ((total, pa.int64()), (own.e, pa.float64()), (own.u, pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "total", "e", "u"])

    def read(r: dict) -> Spectrum:
        return Spectrum(int(r["n"]), np.array(r["total"], np.int64), np.array(r["e"], float), np.array(r["u"], float).reshape(dim, dim))

    def join(found: list[dict]) -> dict:
        first, *more = map(read, found)
        for s in more:
            first.join(s)
        return {"n": first.n, "total": first.total, "e": first.e, "u": first.u.ravel()}

    row = in_tree(mapped(rows.select("vec"), run, "key long, n long, total array<long>, e array<double>, u array<double>"), join)
    return read(row) if row else None


def covariance(rows: DataFrame, dim: int, n: int, total: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the rows' coordinates in the basis, over all rows, centred before multiplying."""
    size = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state: list[dict] = []
        for batch in batches:
            y = centred(whole_numbers(batch, dim), n, total) @ basis
            if len(y):
                mean = y.mean(axis=0)
                state = [joined([*state, {"n": len(y), "mean": mean, "scatter": ((y - mean).T @ (y - mean)).ravel()}])]
        for s in state:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([s["n"]], pa.int64()), pa.array([s["mean"]], pa.list_(pa.float64())), pa.array([s["scatter"]], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "mean", "scatter"])

    row = in_tree(mapped(rows.select("vec"), run, "key long, n long, mean array<double>, scatter array<double>"), joined)
    return np.array(row["scatter"], float).reshape(size, size) / n


def joined(parts: list[dict]) -> dict:
    """Counts, means and centred products of parts, as of all their rows."""
    n, mean, scatter = int(parts[0]["n"]), np.array(parts[0]["mean"], float), np.array(parts[0]["scatter"], float)
    for p in parts[1:]:
        both = n + int(p["n"])
        away = np.array(p["mean"], float) - mean
        scatter = scatter + np.array(p["scatter"], float) + np.outer(away, away).ravel() * (n * int(p["n"]) / both)
        mean, n = mean + away * (int(p["n"]) / both), both
    return {"n": n, "mean": mean, "scatter": scatter}


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x less total / n, rounded once."""
    return (x - total // n) - (total % n) / n


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n x - total) squared, exact."""
    y, rest = x - total // n, total % n  # n x - total = n y - rest
    if float(np.abs(y).max(initial=0)) * n * np.sqrt(x.shape[1]) < 2**31:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    return ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide of every kept row and component."""
    spark = vectors.sparkSession
    out = "n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
    rows = kept(vectors, vec_id, vec)
    length = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    nothing = spark.createDataFrame([], f"component int, {out}").select(F.lit(None).cast(rows.schema["id"].dataType).alias("vec_id"), "*")
    if length is None:
        return nothing
    dim = length["dim"]
    rows = rows.filter(F.size("vec") == dim)
    whole = spectra(rows, dim)
    n, total = whole.n, whole.total
    e, turn = np.linalg.eigh(covariance(rows, dim, n, total, whole.u))
    basis, trace = (whole.u @ turn)[:, ::-1], e.sum()
    e = e[::-1]
    count = int((e > dim * EPS * max(e[0], 0.0) * 16).sum()) if e[0] > 0 else 0
    count = min(count, components)
    if not count:
        return nothing
    basis, e = basis[:, :count], e[:count]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(count)])
    white = basis / np.sqrt(e)
    error = float(np.abs(covariance(rows, dim, n, total, white) - np.eye(count)).max())
    shared = spark.sparkContext.broadcast((white, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, sums = shared.value
        for batch in batches:
            x = whole_numbers(batch, dim)
            y = centred(x, n, sums) @ turn
            away = pa.array(map(Decimal, deviations(x, n, sums)), pa.decimal128(38, 0))
            offsets = pa.array(np.arange(0, y.size + 1, count, dtype=np.int32) if len(y) else np.zeros(1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), away, pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], ["id", "away", "y"])

    kind = rows.schema["id"].dataType.simpleString()
    made = mapped(rows, run, f"id {kind}, away decimal(38,0), y array<double>")
    made = made.select("id", "away", F.posexplode("y").alias("k", "whitened"))
    shares = F.array(*(F.lit(float(x)) for x in e / trace))
    return made.select(F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(away as long)").alias("deviation"), "whitened", F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"), F.col("away").alias("deviation_wide"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
