"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, discard, parts


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b) of the named column pairs, in the partitions of ``df``."""
    rows = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
    return df.select(F.explode(rows).alias("_e")).select("_e.a", "_e.b").where(F.col("a") != F.col("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour or itself."""
    both = _each(edges, ("a", "b"), ("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _each(down.join(least, "a"), ("b", "m"), ("a", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of each id in edges (a, b) but the labels' own: the least id of its component.

    Rounds take a number of steps that grows with the logarithm of the ids; each is written to the
    shared folder and the next reads it, dealt by PART_ROWS edges a partition, so few edges make few
    tasks. Nothing but a count and a checksum reaches the driver.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        old, now = now, cut(_small_star(_large_star(now.coalesce(parts(state[0]))).distinct()).distinct(), "edges")
        discard(old)
        before, state = state, _state(now)
        if state == before:
            break
    # at rest every edge leads to its component's least id
    out = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    out._written_at = now._written_at
    return out


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` of ``components`` after more edges: only these are gone over again, between labels."""
    between = edges
    for c in ("a", "b"):
        between = between.join(labels.select(F.col("id").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    new = components(between)
    moved = labels.join(new.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label", "left")
    out = cut(moved.select("id", F.coalesce("_to", "label").alias("label")).unionAll(new), "labels")
    discard(labels, new)
    return out
