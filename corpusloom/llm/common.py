"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Unlike a local checkpoint it survives the loss of executors, and unlike an RDD checkpoint
    it computes the rows once and keeps them in columns.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in dfs:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that a Python worker is sent; long texts would fill a worker by the 10,000 rows that Spark sends otherwise.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """From now on the session cuts Arrow batches at BATCH_BYTES too, or at the fewer that it was set to."""
    if int(spark.conf.get(_BATCH, str(1 << 28)).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def freed() -> None:
    """Give back to the system what a Python worker holds no longer; for the end of a task, as workers outlive it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows of a few numbers that one partition takes.
PART_ROWS = 1 << 18


def parts(rows: int, each: int = PART_ROWS) -> int:
    """Partitions for so many rows."""
    return max(1, -(-rows // each))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up by byte planes, compressed."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = max(1, int(values.max(initial=0)).bit_length() + 7 >> 3)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(wide[:, :used].T.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.reshape(-1).view("<u8").astype(np.int64)


def _adding(keys: list[str], names: list[str], finish: Callable[[np.ndarray], bytes]):
    """Rows come by ``keys``; each one's counts are added to what is held of its key."""

    def row(key: tuple, total: np.ndarray, kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(key, kinds, strict=False) if k is not None), pa.array([finish(total)], pa.binary())], names=[*names, "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, kinds = None, np.empty(0, np.int64), []
        for b in batches:
            kinds = [b.schema.field(k).type for k in names]
            for key, counts in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("counts"), strict=True):
                more = unsqueezed(counts.as_py())
                if key == held:
                    total += more
                    continue
                if held is not None:
                    yield row(held, total, kinds)
                held, total = key, more
        if held is not None:
            yield row(held, total, kinds)
        freed()

    return run


def added_up(rows: DataFrame, finish: Callable[[np.ndarray], bytes] = squeezed) -> DataFrame:
    """Of rows (keys ..., counts), ``counts`` being ``squeezed`` arrays of one size, one row a key with their sum.

    Arrays are added one after the other as they come, first by key and salt, then by key, so a worker holds one sum and
    one batch however many tasks gave counts, and no task reads more than about the root of their number.
    """
    keys = [c for c in rows.columns if c != "counts"]
    kinds = T.StructType([*(rows.schema[k] for k in keys), T.StructField("counts", T.BinaryType())])
    salted = rows.withColumn("_salt", F.spark_partition_id() % math.isqrt(partitions(rows.sparkSession)))
    for by, end in (([*keys, "_salt"], squeezed), (keys, finish)):
        salted = salted.repartition(*by).sortWithinPartitions(*by).mapInArrow(_adding(by, keys, end), kinds)
    return salted


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def in_slices(batch: pa.RecordBatch, rows: int = 512, room: int | None = None, name: str = "text"):
    """Parts of a batch, so that what Python holds at once stays small.

    With ``room`` a part ends with the row whose text takes it to so many bytes.
    """
    if room is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, int(np.searchsorted(ends, before + room)) + 1, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOST_BITS = 26


def with_mark(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``_marked``: false only for rows whose ``col`` is surely not in ``ids`` (one column, no nulls).

    A bitmap of the ids' hashes, of 16 bits an id up to 2**26 bits, is summed up as 64-bit words
    and broadcast: 2**20 rows at most. Rows that it rules out need no shuffle; the others go on to an exact join.
    """
    (name,) = ids.columns
    n = ids.count()
    k = min(MOST_BITS, max(10, (16 * n).bit_length()))
    ids = ids.coalesce(parts(n))
    mask = (1 << k) - 1

    def at(c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND(F.lit(mask))

    words = ids.select(at(F.col(name)).alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_bits"))
    joined = df.withColumn("_p", at(F.col(col))).withColumn("_word", F.shiftright("_p", 6)).join(F.broadcast(words), "_word", "left")
    return joined.withColumn("_marked", F.coalesce(F.expr("(shiftright(_bits, cast(_p & 63 as int)) & 1L) = 1L"), F.lit(False))).drop("_p", "_word", "_bits")


def without(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``col`` isn't in ``ids``, null ones included; only rows that the bitmap marks are shuffled."""
    marked = with_mark(df, col, ids)
    sure = marked.where(~F.col("_marked")).select(*df.columns)
    unsure = marked.where("_marked").join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_anti")
    return sure.unionAll(unsure.select(*df.columns))
