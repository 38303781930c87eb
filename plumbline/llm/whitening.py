"""Whitening of embeddings through a compensated covariance.

Sums are exact integers. The covariance is accumulated from centred vectors in
double-double: a block of centred values is cut into slices so short that products
of slices, summed over the block, are exact in doubles (an error-free transformation
of the outer products, which leaves them to matrix products); each exact partial sum
then enters a high and a low matrix by two-sum. Tasks send high and low parts by
matrix row, which meet in two rounds of merging, so neither a task nor the driver
gets more than the number of dimensions squares to. The eigen-solve reduces to
tridiagonal form and divides and conquers (LAPACK's syevd); one Newton step in
extended precision, against high and low part together, takes its components to
double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, shuffle_width, stored

#: Vectors in a block, and bits of a slice: twice the bits and those of the block's size are within a double's 53.
BLOCK, SLICE = 1024, 21
#: Slices of a centred value: 105 bits below the largest of its dimension in the block.
SLICES = 5
#: Entries that 1024 * c + 100000 takes out of 63 bits count as not finite.
LARGEST = 2.0**52


# ---------------------------------------------------------------- double-double
def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, error of that sum), exactly a + b."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, other: np.ndarray, more: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (other, more) in double-double."""
    s, e = two_sum(high, other)
    t, f = two_sum(low, more + np.zeros_like(low))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


class Products:
    """Sums of outer products in double-double."""

    def __init__(self, dims: int):
        self.high, self.low = np.zeros((dims, dims)), np.zeros((dims, dims))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Outer products of up to BLOCK rows of values high + low."""
        top = np.abs(high).max(axis=0, initial=0.0)
        scale = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))))
        rest, tail = high / scale, low / scale  # powers of two: exact
        slices = []
        for i in range(1, SLICES + 1):
            grain = 2.0 ** (SLICE * i - 1)
            part = np.rint(rest * grain) / grain
            rest, tail = two_sum(rest - part, tail)
            slices.append(part)
        grid = scale[:, None] * scale[None, :]
        for i, a in enumerate(slices):
            for j in range(i, SLICES - i):
                exact = (a.T @ slices[j]) * grid
                self.high, self.low = add(self.high, self.low, exact)
                if j > i:
                    self.high, self.low = add(self.high, self.low, exact.T)


# ---------------------------------------------------------------- passes
def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def dimensions(frame: DataFrame) -> int:
    """The number of entries of most vectors, the larger of two as frequent; 0 without vectors."""
    found = frame.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _sums(frame: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension) of arrays of longs."""
    one = F.posexplode("vector").alias("dim", "x")
    high, low = F.shiftright("x", 31), F.col("x").bitwiseAND(F.lit((1 << 31) - 1))
    rows = frame.select(one).groupBy("dim").agg(F.count("*").alias("n"), F.sum(high).alias("h"), F.sum(low).alias("l")).collect()
    found = {r["dim"]: (r["n"], (r["h"] << 31) + r["l"]) for r in rows}
    return (found[0][0], [found[i][1] for i in range(dims)]) if found else (0, [])


def _products(frame: DataFrame, dims: int, centre: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) sums of outer products of centred vectors; centre takes an array of vectors to high and low parts."""
    schema = "line long, task long, high array<double>, low array<double>"

    def partial(batches):
        held, n = Products(dims), 0
        for batch in batches:
            vectors = _vectors(batch, dims)
            for i in range(0, len(vectors), BLOCK):
                held.add(*centre(vectors[i : i + BLOCK]))
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.nulls(dims, pa.int64()).fill_null(0), pa.array(list(held.high)), pa.array(list(held.low))], ["line", "task", "high", "low"])

    def merge(group: pa.Table) -> pa.Table:
        high, low = np.zeros(dims), np.zeros(dims)
        for a, b in zip(group.column("high").to_pylist(), group.column("low").to_pylist()):
            high, low = add(high, low, np.array(a), np.array(b))
        return pa.table({"line": group.column("line")[:1], "task": group.column("task")[:1], "high": pa.array([high]), "low": pa.array([low])})

    parts = frame.select("vector").mapInArrow(releasing(partial), schema)
    fan = max(2, int(shuffle_width(frame.sparkSession) ** 0.5))  # tasks of a first round that meet in one row of the second
    dealt = parts.withColumn("task", F.spark_partition_id().cast("long") % fan)
    for keys in (["line", "task"], ["line"]):
        dealt = dealt.groupBy(*keys).applyInArrow(merge, schema)
    high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
    for r in dealt.select("line", "high", "low").toLocalIterator():
        high[r["line"]], low[r["line"]] = r["high"], r["low"]
    return high, low


# ---------------------------------------------------------------- eigenvectors
def components(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the symmetric matrix high + low.

    Equal eigenvalues have some orthonormal vectors of their space.
    """
    values, vectors = np.linalg.eigh((high + high.T) / 2)  # LAPACK's syevd: tridiagonal, divide and conquer
    exact = high.astype(np.longdouble) + low.astype(np.longdouble)
    exact = (exact + exact.T) / 2
    scale = np.abs(exact).max() or np.longdouble(1)
    x = vectors.astype(np.longdouble)
    for _ in range(2):  # Newton's step for all pairs at once; close pairs are only made orthogonal
        r = np.eye(len(x)) - x.T @ x
        s = x.T @ (exact / scale) @ x
        lam = np.diag(s) / (1 - np.diag(r))
        gap = lam[None, :] - lam[:, None]
        close = np.abs(gap) <= 1e-13 * max(1.0, float(np.abs(lam).max()))
        e = np.where(close, r / 2, (s + lam[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
    order = np.argsort(-lam, kind="stable")
    return (lam[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


# ---------------------------------------------------------------- whitening
@dataclass(frozen=True)
class Whitener:
    """What whitening takes from its fit list."""

    n: int
    #: Exact sums of each dimension, of integers.
    sums: list
    high: np.ndarray
    low: np.ndarray
    #: Falling eigenvalues above rounding, and their unit vectors as columns.
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.values / float(np.trace(self.high) + np.trace(self.low))


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector of longs floor(1024 c) + 100000) of rows whose vector and entries are there and finite.

    Entries beyond 2^52 once multiplied count as not finite. Repeated rows and ids stay.
    """
    double = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.forall(double, lambda c: c.isNotNull() & (F.abs(c * 1024) <= LARGEST) & ~F.isnan(c))
    whole = F.transform(double, lambda c: F.floor(F.when(F.abs(c * 1024) <= LARGEST, c * 1024)) + 100000)
    return embeddings.where(F.col(vector_col).isNotNull() & sound).select(F.col(id_col).alias("id"), whole.alias("vector"))


def centring(n: int, sums: list) -> Callable:
    """A function from arrays of integers to high and low parts of what they are less the mean."""
    means = [Fraction(s, n) for s in sums]
    whole = np.array([round(m) for m in means], np.int64)
    rest = [m - int(w) for m, w in zip(means, whole)]
    first = np.array([float(r) for r in rest])
    second = np.array([float(r - Fraction(f)) for r, f in zip(rest, first)])

    def centre(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = (vectors - whole).astype(np.float64)  # exact below 2^53
        high, low = two_sum(off, -first + np.zeros_like(off))
        return two_sum(high, low - second)

    return centre


def fit(vectors: DataFrame) -> Whitener | None:
    """Means, covariance (divisor n) and components of (id, vector of longs); None where there are none.

    Vectors of another length than most have fall out. Eigenvalues within rounding of
    zero have no component.
    """
    dims = dimensions(vectors)
    if not dims:
        return None
    own = vectors.where(F.size("vector") == dims)
    n, sums = _sums(own, dims)
    high, low = _products(own, dims, centring(n, sums))
    high, low = two_sum(high / n, (low + _remainder(high, n)) / n)
    values, unit = components(high, low)
    kept = int((values > max(values[0], 0.0) * dims * 2.0**-50).sum()) if len(values) and values[0] > 0 else 0
    return Whitener(n, sums, high, low, values[:kept], unit[:, :kept])


def _remainder(a: np.ndarray, n: int) -> np.ndarray:
    """a - n * (a / n), in extended precision."""
    q = a / n
    return (a.astype(np.longdouble) - q.astype(np.longdouble) * n).astype(np.float64)


def whiten(vectors: DataFrame, fitted: Whitener, most: int | None = None) -> DataFrame:
    """(id, deviation, whitened): the whitened vector in its first `most` components, and the exact squared distance from the mean times n squared (null beyond a long)."""
    kind = vectors.schema["id"].dataType.simpleString()
    n, dims = fitted.n, fitted.dims
    count = min(len(fitted.values), most or dims)
    turn = fitted.vectors[:, :count] / np.sqrt(fitted.values[:count])
    centre = centring(n, fitted.sums)
    sums = np.array(fitted.sums, object)

    def work(batches):
        for batch in batches:
            x = _vectors(batch, dims)
            high, low = centre(x)
            white = high @ turn + low @ turn
            if float(np.abs(high).max(initial=0.0) * n) ** 2 * dims < 2.0**62:
                off = n * (x - np.array([s // n for s in fitted.sums])) - np.array([s % n for s in fitted.sums])
                far = pa.array((off * off).sum(axis=1), pa.int64())
            else:
                exact = [int(d) for d in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]
                far = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * count, pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), far, lists], ["id", "deviation", "whitened"])

    return vectors.where(F.size("vector") == dims).mapInArrow(releasing(work), f"id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, count: int) -> float:
    """The largest absolute entry of the covariance of whitened vectors minus the identity; 0 without vectors."""
    vectors = white.select(F.col("whitened").alias("vector"))
    # Whitened means are within rounding of zero; what they miss is taken out as a second centring.
    entry: Column = F.posexplode("vector").alias("dim", "x")
    found = {r["dim"]: (r["n"], r["m"]) for r in vectors.select(entry).groupBy("dim").agg(F.count("*").alias("n"), F.avg("x").alias("m")).collect()}
    if not found:
        return 0.0
    mean = np.array([found[i][1] for i in range(count)])
    high, low = _products(vectors, count, lambda x: two_sum(x, -mean + np.zeros_like(x)))
    return float(np.abs((high + low) / found[0][0] - np.eye(count)).max())


REPORT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(embeddings: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component up to `most`: (id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or empty, hold nulls, entries that aren't finite or beyond
    2^52, or have another length than most, fall out. With fewer vectors than
    dimensions, or dimensions that depend on each other, there are fewer components;
    with none that differs from its mean, or an empty table, no rows. Ties of
    eigenvalues and repeated rows and ids are allowed; other columns play no part.
    """
    vectors = quantised(embeddings, id_col, vector_col)
    fitted = fit(vectors)
    if fitted is None or not len(fitted.values):
        return embeddings.sparkSession.createDataFrame([], f"{id_col} {embeddings.schema[id_col].dataType.simpleString()}, {REPORT}")
    count = min(most, len(fitted.values))
    white = stored(whiten(vectors, fitted, count), "whitened")
    error = identity_error(white, count)
    share = F.array(*(F.lit(float(x)) for x in fitted.explained[:count]))
    rows = white.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("place", "value"))
    return rows.select(id_col, (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.element_at(share, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
