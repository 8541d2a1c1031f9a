"""What reviewers do to the decision store, as events for its log, and what a calibration round shows.

``current`` is ``store.state``'s result. Functions return events; the caller appends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.store import EVENT

VERDICTS, REMOVALS = ("YES", "NO"), ("RESET", "CLEAR")


def _events(rows: DataFrame, seq: int, kind: Column | str, **sets: Column) -> DataFrame:
    own = {"seq": F.lit(seq).cast("long"), "paper_id": F.col("paper_id"), "kind": F.lit(kind) if isinstance(kind, str) else kind, "reconcile": F.lit(False)} | sets
    return rows.select(*[own.get(name, F.lit(None)).cast(t).alias(name) for name, t in (c.split(" ") for c in EVENT.split(", "))])


def audited(current: DataFrame, ids: DataFrame, verdict: str, seq: int) -> tuple[DataFrame, DataFrame]:
    """(events, one row of asked, affected, unknown) of a verdict on many papers.

    YES and NO set the verdict of papers that are there and rewrite their codes; RESET and CLEAR delete them.
    Unknown and repeated ids change nothing, and the counts say so.
    """
    if verdict not in (*VERDICTS, *REMOVALS):
        raise ValueError(f"verdict is one of {(*VERDICTS, *REMOVALS)}")
    asked = ids.select("paper_id").distinct()
    known = asked.join(current.select("paper_id"), "paper_id", "left_semi")
    counts = asked.join(current.select("paper_id", F.lit(1).alias("_there")), "paper_id", "left").agg(F.count("*").alias("asked"), F.count("_there").alias("affected"), F.count_if(F.col("_there").isNull()).alias("unknown"))
    if verdict in REMOVALS:
        return _events(known, seq, "delete"), counts
    return _events(known, seq, "audit", human_decision=F.lit(verdict), reconcile=F.lit(True)), counts


def registered(sample: DataFrame, seq: int) -> DataFrame:
    """Events that set a sample's papers back to placeholders that need review and flag them."""
    reset = _events(sample, seq, "decide", status=F.lit("NEEDS_REVIEW"), codes=F.array().cast("array<string>"), confidence=F.lit(0.0))
    return reset.unionByName(_events(sample, seq + 1, "flag"))


def cleared(current: DataFrame, seq: int) -> DataFrame:
    return _events(current.where("is_calibration"), seq, "unflag")


def seeded_from_audits(current: DataFrame, seq: int) -> DataFrame:
    """Events after which the flagged papers are those that were audited."""
    changed = current.where(F.col("is_audited") != F.col("is_calibration"))
    return _events(changed, seq, F.when(F.col("is_audited"), "flag").otherwise("unflag"))


def in_calibration(current: DataFrame) -> DataFrame:
    """One row: whether a sample is there and nothing but it was decided."""
    return current.agg((F.count_if(F.col("is_calibration")) > 0).alias("has_sample"), F.count_if(~F.col("is_calibration")).alias("others")).select((F.col("has_sample") & (F.col("others") == 0)).alias("calibrating"))


def progress(total: int, current: DataFrame, calibrating: bool) -> DataFrame:
    """total, screened, pending, percent; in a calibration round of the sample alone, where pending is what needs review."""
    if calibrating:
        counted = current.where("is_calibration").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "NEEDS_REVIEW").alias("screened"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("pending"))
    else:
        counted = current.agg(F.lit(total).cast("long").alias("total"), F.count("*").alias("screened")).withColumn("pending", F.greatest(F.col("total") - F.col("screened"), F.lit(0)))
    return counted.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("screened") / F.col("total"), 1)).otherwise(0.0))


#: Place of the ids in a result sheet, whose second header is blank.
ID_PLACE = 1


def read_verdicts(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """paper_id and verdict of a reviewers' CSV, as ``export`` writes it: ids in the second column or the one named, verdicts under ``Revisor 1``."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "Revisor 1" not in raw.columns:
        raise ValueError("no column named Revisor 1")
    if id_column is not None and id_column not in raw.columns or len(raw.columns) <= ID_PLACE:
        raise ValueError(f"no column {id_column or 'of ids'}")
    return raw.select(F.col(f"`{id_column or raw.columns[ID_PLACE]}`").alias("paper_id"), F.col("`Revisor 1`").alias("verdict"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def seeded(verdicts: DataFrame, papers: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """(seed events, one row of imported, seeded) of (paper_id, verdict): YES and NO in any case and spacing, of papers in the dataset; ids are stripped."""
    said = verdicts.select(_stripped(F.col("paper_id")).alias("paper_id"), F.upper(_stripped(F.col("verdict"))).alias("verdict")).where(F.col("verdict").isin(*VERDICTS))
    known = said.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    counts = papers.agg(F.count("*").alias("imported")).crossJoin(known.agg(F.count_distinct("paper_id").alias("seeded")))  # one row each
    return _events(known, seq, "seed", human_decision=F.col("verdict")), counts
