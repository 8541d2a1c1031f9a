"""Operator 11: vector code compression by partial-distance search.

A vector is cut into equal consecutive parts, and each part is replaced by the number of its nearest
entry in that position's codebook. Codebooks are fitted in a few rounds over all vectors: a round
assigns every part and moves each entry to the floor of its parts' mean. All arithmetic is on integers.

The nearest entry is found by partial distances: dimensions are taken in descending variance of the
codebook, so that distances grow early. After the first, the likeliest entry of each row is completed; that is
the best complete distance, and (row, entry) pairs whose accumulated distance strictly exceeds it are
dropped by masks, dimension by dimension. Equal distances stay to the end, where the lower index wins.

Distribution: rows stay where they lie. Codebooks (entries x dimensions integers, whatever the input)
are sent with the tasks; a task sums its own parts by entry, entries x (dimensions + parts) rows of two
numbers, which Spark's aggregation adds up before and after the shuffle. Errors by label are summed alike; the sums are joined back, sent
to all tasks only if they are at most MOST_LABELS rows, else by a shuffled join that Spark may split at a hot label.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do those of
another length than most have (the smaller of equally frequent lengths). That length must be a multiple of ``parts``, else
ValueError; so is a component whose integer reaches 2**27. The first entries are the vectors of the smallest ids, null ids last, equal ids
by vector; with fewer vectors than entries there are as many entries. Repeated rows count each, and
null ids and labels are kept. An empty table gives no rows. Extra columns are kept by ``encoded``, but for those with its own names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import cut, lean, table
from corpusloom.llm.vectors import common_length, floors, matrices, with_length

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Integers below this have squared distances whose sum over 2**8 dimensions fits 64 bits.
LIMIT = 1 << 27
#: Rows whose parts are held against a codebook at once.
TOGETHER = 2048
MOST_LABELS = 1 << 16


class Codebooks:
    """parts x entries x width integers, and the order in which a part's dimensions are taken."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books
        self.order = np.argsort(-books.astype(np.float64).var(axis=1), axis=1, kind="stable")

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x parts: the nearest entries and their squared distances."""
        parts, _, width = self.books.shape
        entry, distance = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
        for p in range(parts):
            for at in range(0, len(x), TOGETHER):
                rows = slice(at, at + TOGETHER)
                entry[rows, p], distance[rows, p] = nearest(x[rows, p * width : (p + 1) * width], self.books[p], self.order[p])
        return entry, distance


def nearest(x: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry and squared distance, ties to the lower index."""
    n, k = len(x), len(book)
    if not len(order):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = order[0]
    so_far = (x[:, first, None] - book[None, :, first]) ** 2
    likely = so_far.argmin(axis=1)
    best = ((x - book[likely]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= best[:, None])
    so_far = so_far[row, entry]
    for d in order[1:]:
        so_far += (x[row, d] - book[entry, d]) ** 2
        stays = so_far <= best[row]
        row, entry, so_far = row[stays], entry[stays], so_far[stays]
    # pairs come by row and entry, and each row has one at least: the likely entry never exceeds itself
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.empty(0, np.int64)
    least = np.minimum.reduceat(so_far, begins) if n else np.empty(0, np.int64)
    chosen = np.where(so_far == np.repeat(least, np.diff(np.append(begins, len(row)))), entry, k)
    return (np.minimum.reduceat(chosen, begins) if n else np.empty(0, np.int64)), least


def _first_books(vectors: DataFrame, id_col: str, vec_col: str, dims: int, parts: int, entries: int, scale: int) -> Codebooks:
    vec = F.col(vec_col).cast("array<double>").alias("_v")
    first = vectors.select(F.col(id_col).alias("_i"), vec).orderBy(F.col("_i").asc_nulls_last(), "_v").limit(entries).collect()
    x = floors(np.array([r["_v"] for r in first], np.float64).reshape(len(first), dims), scale, LIMIT)
    return Codebooks(x.reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy())


def _summed(vectors: DataFrame, vec_col: str, books: Codebooks, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """By part and entry: the sums of the parts assigned to it and their number."""
    parts, k, width = books.books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            for _, doubles in matrices(b, "_v", own.dims):
                x = floors(doubles, scale, LIMIT)
                entry, _ = own.assign(x)
                for p in range(parts):
                    count[p] += np.bincount(entry[:, p], minlength=k)
                    np.add.at(total[p], entry[:, p], x[:, p * width : (p + 1) * width])
        flat = np.concatenate([total.reshape(-1), count.reshape(-1)])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "value"])

    rows = vectors.select(F.col(vec_col).cast("array<double>").alias("_v"))
    flat = np.zeros(parts * k * (width + 1), np.int64)
    for r in rows.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[r["at"]] = r["value"]
    return flat[: parts * k * width].reshape(parts, k, width), flat[parts * k * width :].reshape(parts, k)


def fitted(vectors: DataFrame, id_col: str, vec_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all usable vectors; None without any."""
    lean(vectors.sparkSession)
    dims = common_length(vectors, vec_col)
    if dims is None:
        return None
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    kept = with_length(vectors, vec_col, dims)
    books = _first_books(kept, id_col, vec_col, dims, parts, entries, scale)
    for _ in range(rounds):
        total, count = _summed(kept, vec_col, books, scale)
        # numpy's // rounds down; entries without parts stay
        books = Codebooks(np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books.books))
    return books


def encoded(vectors: DataFrame, vec_col: str, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """The rows with a usable vector, all columns but it, with ``code`` (two hex digits a part) and ``error``."""
    if books.books.shape[1] > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    lean(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kept = with_length(vectors, vec_col, books.dims)
    rows = kept.drop("code", "error").withColumn("_v", F.col(vec_col).cast("array<double>"))
    rows = rows.drop(vec_col)
    names = [c for c in rows.columns if c != "_v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts = own.books.shape[0]
        for b in batches:
            for at, doubles in matrices(b, "_v", own.dims):
                entry, distance = own.assign(floors(doubles, scale, LIMIT))
                text = entry.astype(np.uint8).tobytes().hex()
                code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                some = b.slice(at, len(entry))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(code, pa.string()), pa.array(distance.sum(axis=1))], names=[*names, "code", "error"])

    kinds = [f for f in rows.schema.fields if f.name != "_v"]
    return rows.mapInArrow(run, T.StructType([*kinds, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def with_label_error(codes: DataFrame, label_col: str) -> DataFrame:
    """``codes`` (a written table) with ``label_error``, the sum of ``error`` over equal labels, nulls together."""
    sums = codes.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    labels = codes.select(label_col).distinct().limit(MOST_LABELS + 1).count()
    if labels <= MOST_LABELS:
        sums = F.broadcast(sums)
    return codes.drop("label_error").join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = fitted(vectors, "vec_id", "embedding")
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = with_label_error(cut(encoded(vectors, "embedding", books), "codes"), "label")
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _sql() -> str:
    """The contract in SQL: a row a component, codebooks as tables, one CTE a round."""
    steps = []
    for i in range(3):
        steps.append(f"""
d{i} AS (
  SELECT x.r, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c)) AS dist FROM x JOIN b{i} b USING (part, pos) GROUP BY ALL
), a{i} AS (
  SELECT r, part, entry, dist FROM (SELECT *, row_number() OVER (PARTITION BY r, part ORDER BY dist, entry) AS place FROM d{i}) WHERE place = 1
)""")
        if i < 2:
            steps.append(f"""
m{i} AS (
  SELECT x.part, a.entry, x.pos, sum(x.c) AS total, count(*) AS n FROM x JOIN a{i} a USING (r, part) GROUP BY ALL
), b{i + 1} AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.c WHEN m.total % m.n < 0 THEN m.total // m.n - 1 ELSE m.total // m.n END::BIGINT AS c
  FROM b{i} b LEFT JOIN m{i} m USING (part, entry, pos)
)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), flat AS (
  SELECT r, unnest(range(len(e))) AS i, unnest(e)::DOUBLE AS y, len(e) AS dims FROM v
), x AS MATERIALIZED (
  SELECT r, (i // (dims // {PARTS}))::INT AS part, (i % (dims // {PARTS}))::INT AS pos, floor({SCALE} * y)::BIGINT AS c FROM flat
), b0 AS (
  SELECT part, (r - 1)::INT AS entry, pos, c FROM x WHERE r <= {ENTRIES}
), {",".join(steps)}, o AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY r
), h AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS digest FROM b2
), l AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM o JOIN v USING (r) GROUP BY label
)
SELECT v.vec_id, o.code, o.error, l.label_error, h.digest AS codebooks_sha256
FROM o JOIN v USING (r) JOIN l ON l.label IS NOT DISTINCT FROM v.label CROSS JOIN h
"""


ORACLE = {"op11_vector_codes": _sql()}
