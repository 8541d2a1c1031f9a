"""The decision store: an append-only log, and the state that follows from it.

Events have seq (their order), paper_id, kind and what the kind sets:

decide: status, codes, confidence. Verdicts, flags and scores stay.
seed: a human verdict; makes a placeholder that needs review where there is no row; sets the calibration flag.
audit: a human verdict on a row that is there; ``reconcile`` also rewrites its codes by the verdict.
quality: a score; below 2 fails the paper, a later one of 2 or more restores it.
flag, unflag: the calibration flag of a row that is there.
delete: the row goes, with all that was set.

Every part of the state is a maximum over events, so the fold combines before it shuffles and a
paper with very many events needs no more memory than one with few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.review import reconciled_codes

EVENT = "seq long, paper_id string, kind string, status string, codes array<string>, confidence double, human_decision string, score double, reconcile boolean"
MAKES = ("decide", "seed")
FAIL_BELOW = 2.0


def append(spark: SparkSession, events: DataFrame, path: str) -> None:
    """One write job a batch."""
    columns = [c.split()[0] for c in EVENT.split(", ")]
    events.select(*columns).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(path)


def _last(kind: Column, value: Column) -> Column:
    return F.max_by(F.when(kind, value), F.when(kind, F.col("seq")))


def _seq(kind: Column) -> Column:
    return F.max(F.when(kind, F.col("seq")))


def state(log: DataFrame) -> DataFrame:
    """paper_id, status, codes, confidence, human_decision, is_audited, is_calibration, score of each paper that is there."""
    kind = F.col("kind")
    gone = log.where(kind == "delete").groupBy("paper_id").agg(F.max("seq").alias("_gone"))
    live = log.where(kind != "delete").join(gone, "paper_id", "left").where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    made = live.where(kind.isin(*MAKES)).groupBy("paper_id").agg(F.min("seq").alias("_made"))
    live = live.join(made, "paper_id").where(F.col("seq") >= F.col("_made"))
    return finished(live.groupBy("paper_id").agg(*summaries()))


def summaries(of: Column | None = None) -> list[Column]:
    """What a paper's state follows from, as maxima over its events, or over those of them for which ``of`` holds."""
    kind = F.col("kind") if of is None else F.when(of, F.col("kind"))
    decide, quality, verdict, flags = kind == "decide", kind == "quality", kind.isin("seed", "audit"), kind.isin("seed", "flag", "unflag")
    rewrite = (kind == "audit") & F.col("reconcile")
    return [
        _seq(decide).alias("_decided"), _last(decide, F.struct("status", "codes", "confidence")).alias("_d"),
        _last(verdict, F.col("human_decision")).alias("human_decision"), _seq(verdict).alias("_audited"),
        _last(flags, kind != "unflag").alias("_flag"), _seq(flags).alias("_flagged"), _seq(quality).alias("_scored"), _last(quality, F.col("score")).alias("score"),
        _seq(quality & (F.col("score") < FAIL_BELOW)).alias("_failed"), _seq(rewrite).alias("_rewritten"), _last(rewrite, F.col("human_decision")).alias("_verdict"),
    ]


def finished(folded: DataFrame) -> DataFrame:
    """The state of papers whose summaries are in columns."""
    none = F.array().cast("array<string>")
    base = F.coalesce(F.col("_d"), F.struct(F.lit("NEEDS_REVIEW").alias("status"), none.alias("codes"), F.lit(0.0).alias("confidence")))
    since = F.coalesce(F.col("_decided"), F.lit(-1))
    scored = F.col("_scored") > since
    fails = scored & (F.col("score") < FAIL_BELOW)
    was_failed = (F.col("_failed") > since) | ((F.col("_b.status") == "EXCLUDED") & F.array_contains("_b.codes", "QC_FAIL"))
    restored = scored & ~fails & was_failed
    by_score = F.when(fails, F.array(F.lit("QC_FAIL"))).when(restored, none).otherwise(F.col("_b.codes"))
    # codes are those of whatever wrote them last: a score that failed or restored the paper, or a verdict
    rewritten = (F.col("_rewritten") > since) & ~(F.coalesce(fails | restored, F.lit(False)) & (F.col("_scored") > F.col("_rewritten")))
    return folded.withColumn("_b", base).select(
        "paper_id", F.when(fails, "EXCLUDED").when(restored, "INCLUDED").otherwise(F.col("_b.status")).alias("status"),
        F.when(rewritten, reconciled_codes(by_score, F.col("_verdict"))).otherwise(by_score).alias("codes"), F.col("_b.confidence").alias("confidence"),
        "human_decision", F.col("_audited").isNotNull().alias("is_audited"), F.coalesce("_flag", F.lit(False)).alias("is_calibration"), "score",
    )


def definitive(current: DataFrame) -> DataFrame:
    """Papers that a run skips; those that need review are scored again."""
    return current.where(F.col("status").isin("INCLUDED", "EXCLUDED")).select("paper_id")
