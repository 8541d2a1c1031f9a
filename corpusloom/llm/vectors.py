"""Dense vectors as integer matrices, for the operators on whole vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix that a worker holds at once, as numbers.
NUMBERS = 1 << 18


def usable(vec: Column) -> Column:
    """The vector isn't null, and all its components are finite numbers."""
    bad = F.exists(vec.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def common_length(vectors: DataFrame, vec_col: str) -> int | None:
    """The length that most usable vectors have, the smaller of equally frequent ones; None without any."""
    first = vectors.where(usable(F.col(vec_col))).groupBy(F.size(vec_col).alias("_l")).count().orderBy(F.desc("count"), "_l").limit(1).collect()
    return first[0]["_l"] if first else None


def with_length(vectors: DataFrame, vec_col: str, dims: int) -> DataFrame:
    """The rows with a usable vector of ``dims`` components."""
    return vectors.where(usable(F.col(vec_col)) & (F.size(vec_col) == dims))


def matrices(batch: pa.RecordBatch, name: str, dims: int):
    """(first row, matrix of doubles) of parts of a batch whose vectors all have ``dims`` components."""
    step = max(1, NUMBERS // max(1, dims))
    for at in range(0, batch.num_rows, step):
        part = batch.column(name).slice(at, min(step, batch.num_rows - at))
        yield at, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dims)


def floors(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; beyond ``limit`` sums of their products would not be exact, and that is an error."""
    out = np.floor(x * scale)
    if len(out) and out.size and float(np.abs(out).max()) >= limit:
        raise ValueError(f"a component times {scale} reaches {limit:.3g}, beyond which results are not exact")
    return out.astype(np.int64)
