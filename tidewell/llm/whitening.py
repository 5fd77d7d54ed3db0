"""Operator 11, whitening of embeddings with a compensated covariance.

A double-double number is a pair of doubles, a value and its rounding error. Sums and products are taken
with error-free transformations (two-sum, two-product by splitting), so that the pair carries some 32 digits.

1. Entries become whole numbers; each distinct vector stands once in the fit list. Its sums are whole numbers and exact.
2. The mean is a double-double. Tasks centre their vectors, take outer products of what they centred and add these up, all
   in double-double. High and low parts are sent row of the matrix by row of the matrix, and merged in two steps, so no
   task gets more than a bounded share of the parts, and the driver the one matrix.
3. The driver has a matrix of dimension times dimension, whatever the rows. LAPACK's divide and conquer on the
   tridiagonal form (numpy's ``eigh``) gives eigenvectors; two steps of refinement in double-double (Ogita and
   Aishima, 2018) correct them, so small eigenvalues beside large ones are exact too.
4. Tasks project what they centred.

Cases. Vectors that are null, empty, or hold null or non-finite entries are dropped. So are those of another length than
most have (ties: the greatest length); an embedding table has one length. Repeated rows weigh once and are returned each;
ids may be null or of any type. Entries whose 256-fold leaves the range of a long stand at its end. Components without variance (to some 28
digits) have no rows, so there may be fewer than asked for, or none, as with one distinct vector. A deviation beyond a long is null.
An empty table gives no rows. Columns of other names pass by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table, written

SCALE, COMPONENTS = 256, 4
#: Vectors whose outer products are added up pairwise before they join the running sum.
AT_ONCE = 32
#: First merging step: so many groups for each row of the matrix.
SLOTS = 16
#: Variance below this share of the whole is none: far above the error of double-double, far below any real one.
LEAST_SHARE = 1e-28

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def _split(a: np.ndarray) -> Pair:
    high = a * 134217729.0  # 2^27 + 1
    high = high - (high - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    p = a * b
    (ah, al), (bh, bl) = _split(a), _split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_multiply(x: Pair, y: Pair) -> Pair:
    p, e = two_product(x[0], y[0])
    return two_sum(p, e + (x[0] * y[1] + x[1] * y[0]))


def dd_negative(x: Pair) -> Pair:
    return -x[0], -x[1]


def dd_matmul(x: Pair, y: Pair) -> Pair:
    total = np.zeros((x[0].shape[0], y[0].shape[1])), np.zeros((x[0].shape[0], y[0].shape[1]))
    for k in range(x[0].shape[1]):
        total = dd_add(total, dd_multiply((x[0][:, k, None], x[1][:, k, None]), (y[0][None, k], y[1][None, k])))
    return total


def dd_of(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


def pair_of(x: np.ndarray) -> Pair:
    """Longs as double-doubles, exactly."""
    high = x.astype(float)
    return high, (x - high.astype(np.int64)).astype(float)


def centred(x: Pair, mean: Pair) -> Pair:
    s, e = two_sum(x[0], -mean[0])
    return two_sum(s, e + (x[1] - mean[1]))


def outer_sum(y: Pair) -> Pair:
    """Sum of the outer products of the rows of ``y``, upper triangle."""
    i, j = np.triu_indices(y[0].shape[1])
    total = np.zeros(len(i)), np.zeros(len(i))
    for k in range(0, len(y[0]), AT_ONCE):
        high, low = y[0][k : k + AT_ONCE], y[1][k : k + AT_ONCE]
        part = dd_multiply((high[:, i], low[:, i]), (high[:, j], low[:, j]))
        while len(part[0]) > 1:
            half = len(part[0]) // 2
            both = dd_add((part[0][:half], part[1][:half]), (part[0][half : 2 * half], part[1][half : 2 * half]))
            part = tuple(np.concatenate([b, p[2 * half :]]) for b, p in zip(both, part, strict=True))
        total = dd_add(total, (part[0][0], part[1][0]))
    return total


def _merge(parts: DataFrame, *keys: str) -> DataFrame:
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(frame.high.iloc[0])), np.zeros(len(frame.high.iloc[0]))
        for high, low in zip(frame.high, frame.low, strict=True):
            total = dd_add(total, (np.asarray(high), np.asarray(low)))
        return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), total[0].tolist(), total[1].tolist()]], columns=[*keys, "high", "low"])

    return parts.groupBy(*keys).applyInPandas(add, ", ".join([*[f"{k} int" for k in keys], "high array<double>, low array<double>"]))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def scatter(fit: DataFrame, width: int, made: int, prepare: Callable[[np.ndarray], Pair]) -> Pair:
    """Sum over the fit list of the outer products of what ``prepare`` makes of a vector (``made`` numbers), in double-double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = outer_sum(prepare(_matrix(b["x"], width)))
                total = part if total is None else dd_add(total, part)
        if total is not None:
            cuts = np.cumsum(np.arange(made, 0, -1))[:-1]
            high, low = (np.split(t, cuts) for t in total)
            yield pa.record_batch([pa.array(range(made), pa.int32()), pa.array([h.tolist() for h in high]), pa.array([v.tolist() for v in low])], names=["i", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i int, high array<double>, low array<double>")
    parts = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
    rows = _merge(_merge(parts, "i", "slot"), "i").collect()  # a row for each dimension
    out = np.zeros((made, made)), np.zeros((made, made))
    for r in rows:
        for full, part in zip(out, (r["high"], r["low"]), strict=True):
            full[r["i"], r["i"] :] = full[r["i"] :, r["i"]] = part
    return out


def eigen(a: Pair, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric double-double matrix that has no negative ones.

    Doubles don't tell eigenvalues below 1e-16 of the largest from each other, so what lies far below is solved again as a matrix of its own.
    """
    largest = 2.0 ** np.frexp(np.abs(a[0]).max() or 1.0)[1]  # a power of two, so that nothing is rounded
    a = a[0] / largest, a[1] / largest
    size, start = len(a[0]), 0
    x = np.eye(size), np.zeros((size, size))
    while start < size:
        rest = x[0][:, start:], x[1][:, start:]
        block = dd_matmul((rest[0].T, rest[1].T), dd_matmul(a, rest))[0]
        values, q = np.linalg.eigh((block + block.T) / 2)
        rest = dd_matmul(rest, (q[:, ::-1], np.zeros_like(q)))
        for whole, part in zip(x, rest, strict=True):
            whole[:, start:] = part
        start += int((values > 1e-8 * values[-1]).sum()) if values[-1] > LEAST_SHARE else size
    one = np.eye(size), np.zeros((size, size))
    for _ in range(steps):
        xt = x[0].T, x[1].T
        r = dd_add(one, dd_negative(dd_matmul(xt, x)))[0]
        s = dd_matmul(xt, dd_matmul(a, x))[0]
        values = np.diag(s) / (1 - np.diag(r))
        gap, off = values[None, :] - values[:, None], s + values[None, :] * r
        apart = (np.abs(off) < np.abs(gap) / 16) & ~np.eye(size, dtype=bool)
        e = np.where(apart, off / np.where(apart, gap, 1), r / 2)
        x = dd_add(x, dd_matmul(x, (e, np.zeros_like(e))))
    order = np.argsort(-values, kind="stable")
    return values[order] * largest, x[0][:, order]


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    mean: Pair
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        high, low = centred(pair_of(x), self.mean)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that are kept, entries as whole numbers."""
    each = F.transform(vectors[vector_col], lambda c: c.cast("double"))
    # the greatest double is below infinity and NaN; a null entry makes it null
    bad = F.exists(each, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > F.lit(np.finfo(float).max)))
    ends = F.lit(float(np.iinfo(np.int64).min)), F.lit(float(np.iinfo(np.int64).max - 1023))
    kept = vectors.where(vectors[vector_col].isNotNull() & (F.size(vectors[vector_col]) > 0) & ~bad)
    x = F.transform(each, lambda c: F.floor(F.greatest(ends[0], F.least(ends[1], c * SCALE))))
    return kept.select(vectors[id_col].alias("id"), x.alias("x"))


def _most_frequent_length(rows: DataFrame) -> int | None:
    first = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return first and first["width"]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for b in batches:
            x = _matrix(b["x"], width)
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # sums of either stay in a long
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high.sum(0), low.sum(0), strict=True)]
        yield pa.record_batch([pa.array([n, *total], pa.decimal128(38, 0)), pa.array(range(-1, width), pa.int32())], names=["v", "i"])

    rows = fit.select("x").mapInArrow(run, "v decimal(38,0), i int").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # a row for each dimension
    if not rows:
        return 0, []
    n, *sums = [int(r["v"]) for r in rows]
    return n, sums


def fitted(fit: DataFrame, width: int, components: int) -> Whitening | None:
    n, sums = _sums(fit, width)
    if not n:
        return None
    mean = tuple(np.array(t) for t in zip(*[dd_of(Fraction(s, n)) for s in sums], strict=True))
    total = scatter(fit, width, width, lambda x: centred(pair_of(x), mean))
    values, vectors = eigen(total)
    trace = float(np.trace(total[0]))
    keep = [k for k in range(min(components, width)) if values[k] > LEAST_SHARE * trace]
    return Whitening(n, sums, mean, values[keep] / n, vectors[:, keep], trace / n)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over the fit list, divisor n, centred first."""
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k), np.zeros(k)
        for b in batches:
            for row in w.project(_matrix(b["x"], len(w.sums))):
                total = dd_add(total, (row, np.zeros(k)))
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["i", "high", "low"])

    sums = fit.select("x").mapInArrow(run, "i int, high double, low double").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    mean = tuple(np.array([r[c] / w.n for r in sums]) for c in ("high", "low"))
    total = scatter(fit, len(w.sums), k, lambda x: centred((w.project(x), np.zeros(k)), mean))
    return float(np.abs((total[0] + total[1]) / w.n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each vector and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(whole_vectors(vectors, id_col, vector_col), "vectors")
    width = _most_frequent_length(rows)
    if width is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("x") == width)
    fit = written(rows.select("x").distinct(), "fit")
    w = fitted(fit, width, components)
    error = identity_error(fit, w) if len(w.values) else 0.0
    explained = w.values / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, top = len(w.values), np.iinfo(np.int64).max
        sums = np.array(w.sums, dtype=object)
        for b in batches:
            x = _matrix(b["x"], width)
            most = w.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, w.sums))
            exact = np.int64 if width * most**2 <= top else object
            deviation = [int(d) if d <= top else None for d in ((w.n * x.astype(exact) - sums.astype(exact)) ** 2).sum(1)]
            white = w.project(x)
            at = np.repeat(np.arange(len(x)), k)
            columns = [
                b["id"].take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(at), w.n), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(at)),
                pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error)),
            ]
            yield pa.record_batch(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
