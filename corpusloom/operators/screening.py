"""Rules, duplicate detection and the offline screening outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_title
from corpusloom.sources.scratch import written

#: Words that mark a record as no full paper.
EC3_WORDS = ["poster", "editorial", "extended abstract", "keynote", "tutorial"]
FIRST_YEAR = 2015
#: Repeated titles that are sent to all tasks, at some 100 bytes each; of more the papers are shuffled.
MOST_SENT = 1 << 17


def rule_ec1() -> Column:
    language = F.lower(F.trim(F.col("metadata")["Language"]))
    return F.coalesce((language != "") & (language != "english"), F.lit(False))


def rule_ec3(words: list[str] | None = None) -> Column:
    pattern = r"(?iU)\b(" + "|".join(words or EC3_WORDS) + r")\b"
    return F.coalesce(F.col("title").rlike(pattern), F.lit(False)) | F.coalesce(F.exists(F.map_values("metadata"), lambda v: v.rlike(pattern)), F.lit(False))


def rule_ec4() -> Column:
    year = F.col("publication_year")
    return F.coalesce((year > 0) & (year < FIRST_YEAR), F.lit(False))


RULES = {"EC1": rule_ec1, "EC3": rule_ec3, "EC4": rule_ec4}


def first_rule(order: list[str]) -> Column:
    """The code of the first rule in the order that fits; unknown codes are skipped."""
    return F.coalesce(*[F.when(RULES[c](), c) for c in order if c in RULES], F.lit(None).cast("string"))


def mark_duplicates(papers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``papers`` with is_duplicate (EC6).

    A paper without a decision is a duplicate if an earlier one of the same normalized title registered;
    those without a decision or with a definitive one register. Ordinals are unique. Each repeated title's least
    registering ordinal is found by an aggregation and written; up to MOST_SENT of these are sent to all tasks, so
    that papers stay where they lie. Of more, papers are joined by a shuffle, in which Spark splits a hot title's.
    """
    known = papers.withColumn("status", F.lit(None).cast("string")) if existing is None else papers.join(existing.select(F.col("paper_id").alias("id"), "status"), "id", "left")
    registers = F.col("status").isNull() | F.col("status").isin("INCLUDED", "EXCLUDED")
    key = normalize_title(F.col("title"))
    # null titles are a group of their own, and digests keep long titles out of the joins
    keyed = known.withColumn("_key", F.unhex(F.sha2(F.concat(F.when(key.isNull(), "0").otherwise("1"), F.coalesce(key, F.lit(""))), 256)))
    counted = keyed.groupBy("_key").agg(F.min(F.when(registers, F.col("ordinal"))).alias("_first"), F.count("*").alias("_n"))
    firsts = written(counted.where("_n > 1 and _first is not null").select("_key", "_first"), "titles")
    if firsts.count() <= MOST_SENT:
        firsts = F.broadcast(firsts)
    marked = keyed.join(firsts, "_key", "left")
    return marked.select(*known.columns, (F.col("status").isNull() & F.coalesce(F.col("_first") < F.col("ordinal"), F.lit(False))).alias("is_duplicate"))


def outcome(papers: DataFrame, order: list[str]) -> DataFrame:
    """Each paper's code: EC6, else the first rule that fits, else null (to be scored)."""
    return mark_duplicates(papers).withColumn("code", F.when(F.col("is_duplicate"), "EC6").otherwise(first_rule(order)))


def resumed(papers: DataFrame, existing: DataFrame, order: list[str], target: str = "ALL", sample: DataFrame | None = None) -> DataFrame:
    """Papers that a run takes up, with their code: EC6, the first rule that fits, or null (to be scored).

    ``existing`` has paper_id and status. Papers with a definitive decision are skipped but keep later ones of
    their title from being scored; those that need review are taken up again. ``sample`` (paper_id) restricts a calibration round.
    """
    if target != "ALL":
        papers = papers.where(F.col("source_type") == target)
    if sample is not None:
        papers = papers.join(sample.select(F.col("paper_id").alias("id")), "id", "left_semi")
    marked = mark_duplicates(papers, existing).where(F.col("status").isNull() | (F.col("status") == "NEEDS_REVIEW"))
    return marked.withColumn("code", F.when(F.col("is_duplicate"), "EC6").otherwise(first_rule(order)))
