"""Seeded samples by stratum. A row's place is its digest's, so a sample repeats at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import alnum_key


def place(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def pick(df: DataFrame, stratum: str, targets: DataFrame, size: int, id_col: str, seed: int) -> DataFrame:
    """At most ``target`` rows of each stratum and ``size`` in all; targets (stratum, target) has a row a stratum.

    The rank is compared with a constant first, so each task keeps ``size`` rows a stratum before the shuffle.
    """
    ranked = df.withColumn("_place", place(id_col, seed))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_place", id_col))).where(F.col("_rank") <= size)
    return ranked.join(F.broadcast(targets), stratum).where(F.col("_rank") <= F.col("target")).orderBy("_place", id_col).limit(size).drop("_place", "_rank", "target")


def shares(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, target): its share of ``size``, rounded half to even, 1 at least."""
    counted = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())  # of one row a stratum
    return counted.select(stratum, F.greatest(F.lit(1), F.bround(F.lit(float(size)) * F.col("_n") / total, 0).cast("int")).alias("target"))


def audit_sample(decisions: DataFrame, size: int = 100, seed: int = 42) -> DataFrame:
    """Decisions drawn by their status."""
    return pick(decisions, "status", shares(decisions, "status", size), size, "paper_id", seed)


def calibration_sample(papers: DataFrame, size: int = 100, seed: int = 42) -> DataFrame:
    """Papers drawn by source type, of each title's key the first; what WL leaves goes to GL."""
    first = papers.withColumn("_key", alnum_key(F.col("title"))).groupBy("_key").agg(F.min_by(F.struct("id", "source_type"), "ordinal").alias("_p")).select("_p.*")
    share = shares(first, "source_type", size)
    wl = F.coalesce(F.max(F.when(F.col("source_type") == "WL", F.col("target"))).over(Window.partitionBy()), F.lit(0))  # of two rows
    targets = share.select("source_type", F.when(F.col("source_type") == "WL", F.col("target")).otherwise(F.lit(size) - wl).alias("target"))
    return pick(first, "source_type", targets, size, "id", seed)


def few_shot(audited: DataFrame, limit: int = 3, seed: int = 42) -> DataFrame:
    """Audited examples for a prompt."""
    return audited.where(F.col("human_decision").isNotNull()).orderBy(place("paper_id", seed), "paper_id").limit(limit)
