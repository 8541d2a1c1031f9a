"""Operator 1: exact top-k inner-product search with MaxScore.

Vectors are sparse documents in the sense of text retrieval: a dimension is a term and a
component its weight. Items stay where they lie; a task takes its rows in shards of SHARD_ROWS, each with a posting
array and score bounds a term. Queries come in blocks of BLOCK_BYTES, whatever their number, each sent to all tasks. For a query
the terms whose bounds together cannot lift a document to the current threshold are the
non-essential ones: essential postings are traversed, and the others are probed, strongest bound
first, only for documents that still compete. A query begins with the k-th best score among SEEDS
items as its threshold, keeps the best that its task has found from shard to shard, and passes over shards
whose bounds don't reach the threshold. Only rows at or above it leave a task, k a query at most; they are merged by a ranked
window that keeps k rows a query before it shuffles.

Weights may be negative, so bounds are taken from each shard's smallest and largest weight.

Cases: a null vector, or one with a null or non-finite component, takes no part, as does a null
id. A vector shorter than others, however long those are, has weight 0 in the missing dimensions. Repeated rows are
separate candidates and separate queries, each with a ranked list of its own; a query never meets candidates of its own id. Equal scores go to the smaller
id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, lean, table

SHARD_ROWS = 4096
#: Numbers of a block of queries that is sent to all tasks, at 8 bytes each.
BLOCK_NUMBERS = 1 << 21
#: Items that give queries their first threshold; all items are searched all the same.
SEEDS = 2048
#: Documents whose postings are traversed together, and terms probed between two prunings.
TRAVERSE, PROBE = 1024, 8

FOUND = "qkey long, query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, vec): components as floor(scale * x); vectors that take no part are left out."""
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("_v"))
        .where(F.col("id").isNotNull() & F.col("_v").isNotNull())
        .withColumn("_bad", F.exists("_v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
        .where(~F.col("_bad"))
        .select("id", F.transform("_v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))
    )


def _postings(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and weights as one row a term."""
    ids = batch.column("id").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("id").to_numpy()
    lists = batch.column("vec") if isinstance(batch, pa.RecordBatch) else pa.concat_arrays(batch.column("vec").chunks or [pa.array([], pa.list_(pa.int64()))])
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((int(sizes.max(initial=0)), len(ids)), dtype=np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[term, doc] = flat
    return ids, out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many terms; as doubles, which multiply faster, where these hold all sums exactly."""
    dims = max(len(a), len(b))
    a, b = (np.pad(x, ((0, dims - len(x)), (0, 0))) for x in (a, b))
    if dims * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**52:
        return a.astype(np.float64), b.astype(np.float64)
    return a, b


class Search:
    """MaxScore of a block of queries over shards that come one by one; what each query has found so far."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        self.own, self.queries, self.k = own, queries, k
        #: Scores below it are of no use to a query.
        self.least = np.full(len(own), np.iinfo(np.int64).min, np.int64) if least is None else least.copy()
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(own)
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(own)

    def shard(self, ids: np.ndarray, postings: np.ndarray) -> None:
        if not len(ids):
            return
        postings, queries = _alike(postings, self.queries)
        low, high = postings.min(axis=1)[:, None] * queries, postings.max(axis=1)[:, None] * queries
        least, most = np.minimum(low, high), np.maximum(low, high)
        for q in np.flatnonzero(most.sum(axis=0) >= self.least):
            self._query(int(q), ids, postings, queries[:, q], least[:, q], most[:, q])

    def _query(self, q: int, ids: np.ndarray, postings: np.ndarray, query: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        order = np.argsort(least - most, kind="stable")
        weights, least, most = query[order], least[order], most[order]
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])
        for at in range(0, len(ids), TRAVERSE):
            docs = np.arange(at, min(at + TRAVERSE, len(ids)))
            docs = docs[ids[docs] != self.own[q]]
            bound = self.least[q]
            # no document gets further by the terms from i on than rest[i]; before a threshold all are essential
            essential = len(order) if bound == np.iinfo(np.int64).min else min(int(np.searchsorted(-(rest + np.concatenate([[0], np.cumsum(least)])), -bound, side="right")), len(order))
            scores = weights[:essential] @ postings[order[:essential], at : at + TRAVERSE]
            scores = scores[docs - at]
            for j in range(essential, len(order), PROBE):
                keep = scores + rest[j] >= bound
                docs, scores = docs[keep], scores[keep]
                if not len(docs):
                    break
                terms = slice(j, j + PROBE)
                scores = scores + weights[terms] @ postings[np.ix_(order[terms], docs)]
            keep = scores >= bound
            docs, scores = docs[keep], scores[keep].astype(np.int64)
            if len(docs):
                s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids[docs]])
                top = np.lexsort((i, -s))[: self.k]
                self.scores[q], self.ids[q] = s[top], i[top]
                if len(top) == self.k:
                    self.least[q] = max(self.least[q], s[top[-1]])


def _searched(sent, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, queries, least = sent.value
        search, held = Search(own, queries, k, least), []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SHARD_ROWS:
                t = pa.Table.from_batches(held)
                for at in range(0, t.num_rows, SHARD_ROWS):
                    search.shard(*_postings(t.slice(at, SHARD_ROWS).combine_chunks()))
                held = []
        if held:
            search.shard(*_postings(pa.Table.from_batches(held).combine_chunks()))
        size = [len(s) for s in search.scores]
        cols = [np.repeat(keys, size), np.repeat(own, size), np.concatenate([*search.ids, np.empty(0, np.int64)]), np.concatenate([*search.scores, np.empty(0, np.int64)])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["qkey", "query_id", "vec_id", "score"])

    return run


def _with_thresholds(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """qkey, id, vec, least: the k-th best score of each query among SEEDS items, or the least number there is."""
    seeds = queries.sparkSession.sparkContext.broadcast(_postings(items.limit(SEEDS).toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                search = Search(*_postings(part), k)
                search.shard(*seeds.value)
                yield pa.RecordBatch.from_arrays([part.column("qkey"), part.column("id"), part.column("vec"), pa.array(search.least)], names=["qkey", "id", "vec", "least"])

    return queries.withColumn("qkey", F.monotonically_increasing_id()).select("qkey", "id", "vec").mapInArrow(run, "qkey long, id long, vec array<long>, least long")


def topk(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for frames of (id long, vec array<long>).

    Queries are written with their thresholds, dealt over as many blocks as BLOCK_NUMBERS asks for. A block is sent to the tasks, and these read all items once for it;
    so what is sent at once has a bound, and items aren't shuffled.
    """
    spark = items.sparkSession
    lean(spark)
    asked = cut(_with_thresholds(queries, items, k), "queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, -(-size["n"] * max(1, size["dims"]) // BLOCK_NUMBERS))
    found = []
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("qkey"), F.lit(blocks)) == i).toArrow()
        if not block.num_rows:
            continue
        own, numbers = _postings(block.combine_chunks())
        sent = spark.sparkContext.broadcast((block.column("qkey").to_numpy(), own, numbers, block.column("least").to_numpy()))
        best = items.select("id", "vec").mapInArrow(_searched(sent, k), FOUND)
        found.append(best if blocks == 1 else cut(best, "found"))
    ranked = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    tiles = functools.reduce(DataFrame.unionAll, found)
    return tiles.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk(vectors.where(F.col("id") % 50 == 0), vectors, 5)


QUERIES = {"op1_topk_search": op1_topk_search}

ORACLE = {
    "op1_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
