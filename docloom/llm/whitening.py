"""Whitening of embeddings by cyclic Jacobi.

Entries are fixed-point numbers x = floor(scale * c) + shift. Spark sums them, and then their products after the integer
mean of each dimension is taken off, which is exact: partial scatters hold whole numbers and what the integer mean lacks
of the true one is corrected in whole numbers too, so neither the order of tasks nor a lost executor changes a bit of the
covariance. Only where n times the largest square passes 2^62 are the partial sums doubles.

The driver holds the covariance (the square of the number of dimensions) and turns it by Jacobi rotations, each round of
which takes disjoint pairs, until every off-diagonal entry is small against the two diagonal ones: a test relative to both
gives small eigenvalues to as many digits as large ones. Eigenvalues are sorted and the whitening matrix is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
TOLERANCE = 1e-15
MAX_SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """``low`` + ``rest`` / n is the mean of x; ``matrix`` has a column for each component, by falling eigenvalue."""

    n: int
    low: np.ndarray
    rest: np.ndarray
    largest: int
    values: np.ndarray
    explained: np.ndarray
    matrix: np.ndarray
    scale: float
    shift: int


def usable(embeddings: DataFrame, vec: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part and how many entries they have.

    Null and empty vectors and those with a null, infinite or undefined entry are left out, and so are vectors whose
    length is not the most common one (of equally common ones the largest). No such row: 0 entries.
    """
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = embeddings.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).filter(F.forall(vec, ok))
    sizes = rows.groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n"))
    d = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.filter(F.size(vec) == (d or 0)), d or 0


def _entries(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _fixed(c: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.floor(scale * c).astype(np.int64) + shift


def _summed(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Row i of a matrix whose parts are rows (i, v): added up as they come in, so that a task holds its rows of the matrix alone."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            own = b.column("v")
            for k, i in enumerate(b.column("i").to_pylist()):
                v = own[k].values.to_numpy(zero_copy_only=False)
                held[i] = held[i] + v if i in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()))], ["i", "v"])

    total = parts.repartition("i").mapInArrow(add, f"i int, v array<{kind}>")
    return {r["i"]: np.array(r["v"]) for r in total.collect()}  # the matrix: bounded by the dimensions


def jacobi(a: np.ndarray, tolerance: float = TOLERANCE, sweeps: int = MAX_SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, their largest entry positive) of a symmetric matrix."""
    a = np.array(a, dtype=np.float64)
    n = len(a)
    v = np.eye(n)
    ring = list(range(n + n % 2))
    half = len(ring) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[:half], ring[half:][::-1], strict=True) if max(x, y) < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
            off = a[p, q]
            large = np.abs(off) > tolerance * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not large.any():
                continue
            turned = True
            p, q, off = p[large], q[large], off[large]
            top, low = a[p, p], a[q, q]
            with np.errstate(over="ignore", divide="ignore"):
                theta = (low - top) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            x, y = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, p], a[q, q] = top - t * off, low + t * off
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    e, v = e[order], v[:, order]
    if n:
        v = v * np.where(v[np.argmax(np.abs(v), axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return e, v


def fit(rows: DataFrame, d: int, components: int | None = COMPONENTS, vec: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all ``rows`` (of ``usable``); None without rows.

    A component without variance, up to rounding, whitens everything to 0. Entries whose fixed-point number passes 2^53
    are an error, as neither a double nor a sum would hold them.
    """
    if not d:
        return None
    spark = rows.sparkSession
    x = F.transform(vec, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    stats = rows.select(F.posexplode(x).alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("a"), F.max("x").alias("z"))
    found = sorted(stats.collect())
    if not found:
        return None
    n = found[0]["n"]
    if max(max(-r["a"], r["z"]) for r in found) + abs(shift) >= 1 << 53:
        raise ValueError("an entry is too large for a fixed-point number")
    sums = [int(r["s"]) + n * shift for r in found]
    low = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    largest = max(max(m - r["a"] - shift, r["z"] + shift - m) for r, m in zip(found, low.tolist(), strict=True))
    exact = n * largest * largest < 1 << 62
    whole = max(1, (1 << 53) // max(1, largest * largest))  # so many products add up without rounding
    low_sent = spark.sparkContext.broadcast(low)  # one number a dimension

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), np.int64 if exact else np.float64)
        for b in batches:
            y = (_fixed(_entries(b.column(0), d), scale, shift) - low_sent.value).astype(np.float64)
            for at in range(0, len(y), min(whole, 4096)):
                part = y[at : at + min(whole, 4096)]
                total += (part.T @ part).astype(total.dtype)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total))], ["i", "v"])

    kind = "long" if exact else "double"
    got = _summed(rows.select(vec).mapInArrow(scatter, f"i int, v array<{kind}>"), kind)
    cov = np.zeros((d, d))
    for i, row in got.items():
        for j, s in enumerate(row.tolist()):
            cov[i, j] = (n * s - int(rest[i]) * int(rest[j])) / (n * n)
    e, v = jacobi(cov)
    k = d if components is None else min(components, d)
    trace = sum(np.diag(cov).tolist())
    alive = e > d * np.finfo(float).eps * max(e[0], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = np.where(alive, v / np.sqrt(np.where(alive, e, 1.0)), 0.0)
    explained = np.where(alive, e, 0.0) / trace if trace > 0 else np.zeros(d)
    return Whitening(n, low, rest, int(largest), e[:k], explained[:k], np.ascontiguousarray(matrix[:, :k]), scale, shift)


def _whitened(w: Whitening, y: np.ndarray) -> np.ndarray:
    return (y - w.rest / w.n) @ w.matrix


def identity_error(rows: DataFrame, w: Whitening, vec: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components that have variance."""
    d, k = w.matrix.shape
    sent = rows.sparkSession.sparkContext.broadcast(w)  # dimensions x components

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros((k + 1, k)), sent.value
        for b in batches:
            z = _whitened(own, _fixed(_entries(b.column(0), d), own.scale, own.shift) - own.low)
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(total))], ["i", "v"])

    got = _summed(rows.select(vec).mapInArrow(scatter, "i int, v array<double>"), "double")
    mean = got[k] / w.n
    cov = np.stack([got[i] for i in range(k)]) / w.n - np.outer(mean, mean)
    alive = w.matrix.any(axis=0)
    off = np.abs(cov - np.eye(k))[np.ix_(alive, alive)]
    return float(off.max()) if off.size else 0.0


def whiten(rows: DataFrame, w: Whitening, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row per row: id, deviation decimal(38,0), whitened array<double>.

    ``deviation`` is the sum over dimensions of (n * x - S)^2, exactly. Ids may be null or repeat; other columns are left out.
    """
    d, k = w.matrix.shape
    sent = rows.sparkSession.sparkContext.broadcast(w)  # dimensions x components
    id_type = to_arrow_type(rows.schema[id].dataType)
    fits = d * (w.n * (w.largest + 1)) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            y = _fixed(_entries(b.column(1), d), own.scale, own.shift) - own.low
            apart = own.n * (y if fits else y.astype(object)) - own.rest
            deviation = (apart * apart).sum(axis=1)
            exact = pa.array(deviation, pa.int64()).cast(pa.decimal128(38, 0)) if fits else pa.array(deviation.tolist(), pa.decimal128(38, 0))
            z = _whitened(own, y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(z) + 1) * k, k), pa.int32()), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), exact, lists], [id, "deviation", "whitened"])

    return rows.select(id, vec).mapInArrow(run, f"{id} {dict(rows.dtypes)[id]}, deviation decimal(38,0), whitened array<double>")


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every vector; a deviation that no long holds is an error. An empty table gives no rows."""
    rows, d = usable(C.table(spark, sf_dir, "embeddings"))
    w = fit(rows, d)
    if w is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(x)) for x in w.explained])
    out = whiten(rows, w).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(identity_error(rows, w)).alias("identity_error"),
    )
