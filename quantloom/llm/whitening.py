"""Embedding whitening: compensated covariance over all distinct vectors, and projection on its leading components.

Entries become fixed-point integers, so counts and sums are exact. Rows are centred before they are multiplied; products and
sums are double-double numbers made with error-free transformations (two-sum, Dekker's product), so each task adds up its blocks
of the distinct vectors, and the tasks' high and low parts are merged in two rounds. What reaches the driver has the size of
the dimension, whatever the number of rows. There LAPACK's tridiagonal divide-and-conquer solver gives the components, which a
correction against the double-double matrix refines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import text as tx

#: Entries beyond this have no exact fixed-point double; such rows are left out like non-finite ones.
LIMIT = 2.0**46
#: Pairs of dimensions that are one row of a task's result, and products made at once.
SLICE, AT_ONCE = 1 << 16, 1 << 16
_LOW = 26
_SPLIT = 134217729.0  # 2**27 + 1, Dekker's constant

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as its double and what that lacks, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b as its double and what that lacks, exactly (unless it over- or underflows)."""
    p = a * b
    x, y = _SPLIT * a, _SPLIT * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """Sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    h = s + e
    e = (e - (h - s)) + f
    top = h + e
    return top, e - (top - h)


def total(x: Pair) -> Pair:
    """Sum over the first axis, pairwise."""
    high, low = x
    while len(high) > 1:
        half = len(high) // 2
        h, e = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (np.concatenate([h, high[2 * half :]]), np.concatenate([e, low[2 * half :]])) if len(high) % 2 else (h, e)
    return high[0], low[0]


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """x - mean, row by row, as double-double."""
    s, e = two_sum(x, -mean[0])
    e = e - mean[1]
    h = s + e
    return h, e - (h - s)


def outer_sums(d: Pair, rows: np.ndarray, cols: np.ndarray) -> Pair:
    """Sums over all vectors of d[:, rows] * d[:, cols]."""
    out = (np.zeros(len(rows)), np.zeros(len(rows)))
    step = max(1, AT_ONCE // max(1, len(rows)))
    for at in range(0, len(d[0]), step):
        h, e = d[0][at : at + step], d[1][at : at + step]
        a, b = h[:, rows], h[:, cols]
        p, q = two_product(a, b)
        q = q + (a * e[:, cols] + e[:, rows] * b)
        out = add(out, total((p, q)))
    return out


def fixed_point(rows: DataFrame, column: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """rows with x: array<long>, floor(scale * entry) + shift. Null or empty vectors go, and those with a null, non-finite or
    huge (LIMIT) entry. A column named x is replaced."""
    vector = F.col(f"`{column}`").cast("array<double>")
    fit = F.size(vector) > 0, F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LIMIT), F.lit(False)))
    return rows.where(vector.isNotNull() & fit[0] & fit[1]).withColumn("x", F.transform(vector, lambda c: F.floor(c * scale) + shift))


def _blocks(x: DataFrame) -> DataFrame:
    """The distinct vectors, packed by length: dims, n and the compressed entries of n vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                own = lists.filter(pa.array(sizes == dims)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.record_batch([pa.array([dims], pa.int64()), pa.array([len(own) // dims], pa.int64()), pa.array([squeeze(own.tobytes())], pa.binary())], ["dims", "n", "data"])

    return tx.reliable(x.select("x").distinct().mapInArrow(pack, "dims long, n long, data binary"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for dims, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            yield np.frombuffer(open_(data.as_py()), dtype=np.int64).reshape(-1, dims)


def _sums(blocks: DataFrame, dims: int) -> list[int]:
    """Exact sums of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for x in _unpack(batches):
            high, low = high + (x >> _LOW).sum(0), low + (x & ((1 << _LOW) - 1)).sum(0)
        yield pa.record_batch([pa.array(np.arange(dims)), pa.array(high), pa.array(low)], ["dim", "high", "low"])

    found = blocks.mapInArrow(run, "dim long, high long, low long").groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # a row per dimension
    return [(r["high"] << _LOW) + r["low"] for r in sorted(found)]


def _covariance(blocks: DataFrame, dims: int, n: int, vectors: Callable[[np.ndarray], Pair]) -> Pair:
    """Mean over all n distinct vectors x of the outer products of vectors(x), which has `dims` entries, as double-double."""
    rows, cols = np.triu_indices(dims)
    cuts = range(0, len(rows), SLICE)
    fan = math.isqrt(max(1, blocks.rdd.getNumPartitions() - 1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(len(rows[c : c + SLICE])), np.zeros(len(rows[c : c + SLICE]))) for c in cuts]
        for x in _unpack(batches):
            d = vectors(x)
            sums = [add(s, outer_sums(d, rows[c : c + SLICE], cols[c : c + SLICE])) for s, c in zip(sums, cuts, strict=True)]
        group = (TaskContext.get().partitionId() if TaskContext.get() else 0) % fan
        yield pa.record_batch([pa.array(range(len(sums)), pa.int64()), pa.array([group] * len(sums), pa.int64()), pa.array([s[0] for s in sums], pa.list_(pa.float64())), pa.array([s[1] for s in sums], pa.list_(pa.float64()))], ["slice", "part", "high", "low"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        high, low = total((np.stack(frame["high"].to_list()), np.stack(frame["low"].to_list())))
        return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "part": [0], "high": [high], "low": [low]})

    kind = "slice long, part long, high array<double>, low array<double>"
    found = blocks.mapInArrow(run, kind).groupBy("slice", "part").applyInPandas(merge, kind).groupBy("slice").applyInPandas(merge, kind).collect()  # as many numbers as pairs of dimensions
    found.sort()
    out = tuple(np.zeros((dims, dims)) for _ in range(2))
    for side, name in zip(out, ("high", "low"), strict=True):
        side[rows, cols] = side[cols, rows] = np.concatenate([np.asarray(r[name], float) for r in found])
    mean = out[0] / n  # long division: what n times the quotient lacks goes to the low part
    p, e = two_product(mean, np.full_like(mean, n))
    return mean, ((out[0] - p) - e + out[1]) / n


def components(cov: Pair, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors as columns, of numerically positive values only.

    np.linalg.eigh is LAPACK's syevd: tridiagonal reduction, then divide and conquer. Each vector is then corrected by what its
    residual, taken in extended precision from both parts of the matrix, says along all other vectors that are apart from it.
    """
    values, basis = np.linalg.eigh(cov[0])
    values, basis = values[::-1], basis[:, ::-1]
    n = min(most, int((values > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()))
    wide = np.longdouble
    matrix, every, own, spread = cov[0].astype(wide) + cov[1], basis.astype(wide), values.astype(wide), np.abs(values[0])
    x = every[:, :n]
    for _ in range(2):
        if not n:
            break
        image = matrix @ x
        e = (x * image).sum(0) / (x * x).sum(0)
        rest = every.T @ (image - x * e)
        gap = e[None, :] - own[:, None]
        apart = np.abs(gap) > 1e-11 * spread
        apart[np.arange(n), np.arange(n)] = False
        x = x + every @ np.where(apart, rest / np.where(apart, gap, 1), 0)
        x = x / np.sqrt((x * x).sum(0))
    image = matrix @ x
    e = (x * image).sum(0)
    top = np.abs(x).argmax(0) if n else []
    x = x * np.where(x[top, np.arange(n)] < 0, -1, 1) if n else x
    return e.astype(float), x.astype(float)


@dataclass
class Whitening:
    """n distinct vectors, their exact sums, mean (high and low), components and eigenvalues, trace, and the measured error."""

    n: int
    sums: list[int]
    mean: Pair
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        h, e = centred(x.astype(float), self.mean)
        return (h @ self.vectors + e @ self.vectors) / np.sqrt(self.values)


def fit(x: DataFrame, most: int = 16) -> Whitening | None:
    """Fits on the distinct vectors of x (column x, array<long>), of the length that most of them have (the shorter of two);
    None without any. Constant vectors, or a single one, have no components."""
    blocks = _blocks(x)
    sizes = sorted(blocks.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect())
    if not sizes:
        return None
    dims, n = sizes[0]
    blocks = blocks.where(F.col("dims") == dims)
    sums = _sums(blocks, dims)
    exact = [Fraction(s, n) for s in sums]
    high = np.array([float(f) for f in exact])
    mean = high, np.array([float(f - Fraction(h)) for f, h in zip(exact, high.tolist(), strict=True)])
    cov = _covariance(blocks, dims, n, lambda v: centred(v.astype(float), mean))
    values, vectors = components(cov, most)
    model = Whitening(n, sums, mean, values, vectors, float(np.trace(cov[0]) + np.trace(cov[1])), 0.0)
    k = len(values)
    if k:

        def extended(v: np.ndarray) -> Pair:
            w = np.column_stack([model.whiten(v), np.ones(len(v))])  # the ones bring the mean of what is whitened
            return w, np.zeros_like(w)

        moments = _covariance(blocks, k + 1, n, extended)[0]
        model.identity_error = float(np.abs(moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k]) - np.eye(k)).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - sum) ** 2 by row, exact; None beyond 2 ** 63 - 1."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
            return (y * y).sum(1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """For every row of fixed_point() of the model's length, repeated ones too, and every component: key, component (from 1),
    n, deviation, whitened, explained, identity_error. Other columns are not read."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    k, dims = len(model.values), len(model.sums)
    share = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = pa.compute.equal(lists.value_lengths(), dims)
            ids, x = batch.column(0).filter(fits), lists.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            if not len(ids):
                continue
            each = pa.array(np.repeat(np.arange(len(ids)), k))
            off = pa.array(_deviations(x, model.n, model.sums), pa.int64())
            tile = lambda v: pa.array(np.tile(v, len(ids)))
            yield pa.record_batch(
                [ids.take(each), tile(np.arange(1, k + 1, dtype=np.int32)), tile(np.full(k, model.n)), off.take(each), pa.array(model.whiten(x).ravel()), tile(share), tile(np.full(k, model.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, "x").mapInArrow(run, schema)
