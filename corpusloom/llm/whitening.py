"""Operator 13: embedding whitening by cyclic Jacobi rotations.

Components become integers, floor(scale * c) + offset, so that sums over all vectors are exact. A first
pass sums them by dimension. A second sums the scatter of vectors centred at the floor of the mean: small
integers, whose products are exact too; the fraction by which that centre misses the mean is taken out with
whole numbers at the end. So the covariance is right to the last place of a double, however far the offset lies from zero.

The driver diagonalizes the covariance (dimensions x dimensions, whatever the number of vectors) by cyclic
Jacobi: every off-diagonal entry is rotated away in turn until each is lost beside the root of its
two diagonal ones, a relative test under which small eigenvalues are accurate. Eigenvectors, sorted by falling eigenvalue, are sent to all
tasks as the whitening matrix.

Distribution: rows stay where they lie; a task gives one row a pair of dimensions, which Spark's aggregation adds up
before and after the shuffle. Vectors are read once a pass (lengths, sums, scatter, check, output); nothing wide is written.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do those of
another length than most have (the smaller of equally frequent lengths). A component times the scale that reaches 2**50 is a ValueError.
A component without variance (eigenvalue below 1e-13 of the trace) has ``whitened`` null and isn't counted in
``identity_error``; with a single vector all are so, and ``explained`` is null where the trace is 0. ``deviation`` is a
decimal(38, 0); the query's long is null where it doesn't fit. Null ids are kept, repeated rows count each. An empty table gives
no rows. Extra columns are kept by ``whitened``, but for those with its own names.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import lean, table
from corpusloom.llm.vectors import common_length, floors, matrices, with_length

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LIMIT = 1 << 50
SWEEPS = 100
#: Off-diagonal entries below this times the root of their diagonal ones have vanished; eigenvalues below FLAT of the trace are no variance.
VANISHED, FLAT = 1e-17, 1e-13
#: Sums leave a task as high * 2**SPLIT + low, so that they don't overflow.
SPLIT = 32
#: Rows whose products are summed at once.
ROWS = 4096


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    a, n = symmetric.astype(np.float64), len(symmetric)
    vectors = np.eye(n)
    for _ in range(SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if abs(off) <= VANISHED * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s, diagonal = t * c, (a[p, p] - t * off, a[q, q] + t * off)
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q], a[:, p], a[:, q] = row_p, row_q, row_p, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = *diagonal, 0.0, 0.0
                vectors[:, p], vectors[:, q] = c * vectors[:, p] - s * vectors[:, q], s * vectors[:, p] + c * vectors[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def _exact_product(z: np.ndarray) -> np.ndarray:
    """z.T @ z of integers; by doubles where these are exact."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 53:
        d = z.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    o = z.astype(object)
    return o.T @ o


def _rows_of(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    high = [int(v) >> SPLIT for v in values]
    low = [int(v) & ((1 << SPLIT) - 1) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["at", "high", "low"])


def _total(parts: DataFrame, size: int) -> list[int]:
    out = [0] * size
    for r in parts.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r["at"]] = (r["high"] << SPLIT) + r["low"]
    return out


class Whitening:
    """What all rows need: n, the sums by dimension, eigenvalues and eigenvectors, and the trace."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]], centre: list[int], scale: int, offset: int, components: int) -> None:
        self.n, self.sums, self.centre, self.scale, self.offset = n, sums, centre, scale, offset
        self.dims = len(sums)
        rest = [s - n * c for s, c in zip(sums, centre, strict=True)]  # sums of the centred integers
        # whole numbers up to the one division, which Python rounds rightly
        covariance = np.array([[(n * scatter[i][j] - rest[i] * rest[j]) / (n * n) for j in range(self.dims)] for i in range(self.dims)]).reshape(self.dims, self.dims)
        self.rest = rest
        self.trace = float(np.trace(covariance))
        values, vectors = jacobi(covariance)
        self.values, self.vectors = values[:components], vectors[:, :components]
        self.varies = self.values > FLAT * self.trace
        self.matrix = self.vectors / np.sqrt(np.where(self.varies, self.values, 1.0))

    def centred(self, doubles: np.ndarray) -> np.ndarray:
        """n * x - S as whole numbers."""
        z = floors(doubles, self.scale, LIMIT) + (self.offset - np.array(self.centre, np.int64))
        rest = np.array(self.rest, dtype=object if max(map(abs, self.rest), default=0) >> 62 else np.int64)
        if self.n * int(np.abs(z).max(initial=0)) >> 62 or rest.dtype == object:
            return self.n * z.astype(object) - rest
        return self.n * z - rest

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Rows x components."""
        return (centred / self.n).astype(np.float64) @ self.matrix


def fitted(vectors: DataFrame, vec_col: str, scale: int = SCALE, offset: int = OFFSET, components: int = COMPONENTS) -> Whitening | None:
    """From all usable vectors; None without any."""
    lean(vectors.sparkSession)
    dims = common_length(vectors, vec_col)
    if dims is None:
        return None
    rows = with_length(vectors, vec_col, dims).select(F.col(vec_col).cast("array<double>").alias("_v"))

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for b in batches:
            for _, doubles in matrices(b, "_v", dims):
                n += len(doubles)
                total = total + (floors(doubles, scale, LIMIT) + offset).sum(axis=0)
        yield _rows_of(np.arange(dims + 1), [*total, n])

    *sums, n = _total(rows.mapInArrow(summing, "at int, high long, low long"), dims + 1)
    centre = [s // n for s in sums]
    shift = np.array([offset - c for c in centre], np.int64)
    upper = np.triu_indices(dims)

    def scattering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for b in batches:
            for _, doubles in matrices(b, "_v", dims):
                z = floors(doubles, scale, LIMIT) + shift
                for at in range(0, len(z), ROWS):
                    total = total + _exact_product(z[at : at + ROWS])
        yield _rows_of(np.arange(len(upper[0])), total[upper])

    flat = _total(rows.mapInArrow(scattering, "at int, high long, low long"), len(upper[0]))
    scatter = [[0] * dims for _ in range(dims)]
    for i, j, v in zip(*upper, flat, strict=True):
        scatter[i][j] = scatter[j][i] = v
    return Whitening(n, sums, scatter, centre, scale, offset, components)


def identity_error(vectors: DataFrame, vec_col: str, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened vectors differs from the identity; 0 without variance."""
    k = len(model.values)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for _, doubles in matrices(b, "_v", shared.value.dims):
                w = shared.value.project(shared.value.centred(doubles))
                total += w.sum(axis=0)
                product += w.T @ w
        flat = np.concatenate([total, product[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    rows = with_length(vectors, vec_col, model.dims).select(F.col(vec_col).cast("array<double>").alias("_v"))
    got = {r["at"]: r["value"] for r in rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([got[i] for i in range(k)]) / model.n
    covariance = np.zeros((k, k))
    covariance[upper] = np.array([got[k + i] for i in range(len(upper[0]))]) / model.n
    covariance[upper] -= np.outer(mean, mean)[upper]
    off = np.abs(covariance - np.diag(model.varies.astype(np.float64)))[np.ix_(model.varies, model.varies)]
    return float(off.max(initial=0.0))


def whitened(vectors: DataFrame, vec_col: str, model: Whitening) -> DataFrame:
    """A row for each usable vector and component: all columns but the vector, with component, deviation, whitened, explained."""
    lean(vectors.sparkSession)
    own = ("component", "deviation", "whitened", "explained")
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    rows = with_length(vectors, vec_col, model.dims).drop(*own).withColumn("_v", F.col(vec_col).cast("array<double>")).drop(vec_col)
    names = [c for c in rows.columns if c != "_v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
        for b in batches:
            for at, doubles in matrices(b, "_v", model.dims):
                centred = model.centred(doubles)
                exact = centred.dtype != object and model.dims * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63
                square = (centred if exact else centred.astype(object)) ** 2
                deviation = pa.array([decimal.Decimal(int(v)) for v in square.sum(axis=1)], pa.decimal128(38, 0))
                w = model.project(centred)
                take = pa.array(np.repeat(np.arange(len(w)), k))
                some = b.slice(at, len(w))
                flat = w.reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(some.column(c).take(take) for c in names), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), deviation.take(take),
                        pa.array(flat, mask=np.tile(~model.varies, len(w))), pa.array(np.tile(explained, len(w)), from_pandas=True),
                    ],
                    names=[*names, *own],
                )

    kinds = [f for f in rows.schema.fields if f.name != "_v"]
    added = [T.StructField("component", T.IntegerType()), T.StructField("deviation", T.DecimalType(38, 0)), *(T.StructField(c, T.DoubleType()) for c in own[2:])]
    return rows.mapInArrow(run, T.StructType([*kinds, *added]))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fitted(vectors, "embedding")
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, "embedding", model)
    return whitened(vectors, "embedding", model).select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {"op13_whitening": op13_whitening}
ORACLE: dict[str, str] = {}
