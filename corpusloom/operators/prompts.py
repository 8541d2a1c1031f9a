"""Prompts for a scoring model, a row a paper, by string expressions: the model's call itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the mark of an abstract that a catalogue gave, with a blank line after it.
RETRIEVED = "[Abstract automatically retrieved via Crossref API]"


def criteria_text(criteria: DataFrame, kind: str) -> str:
    """``code: description`` lines of a kind in order of their codes; a review's criteria are a closed list of a few dozen."""
    rows = criteria.where(F.col("type") == kind).orderBy("code").select("code", "description").collect()
    return "\n".join(f"{r['code']}: {r['description']}" for r in rows)


def examples_text(examples: DataFrame) -> str:
    """Of the few examples that ``few_shot`` picked."""
    rows = examples.orderBy("id").select("title", "human_decision").collect()
    return "\n".join(f"{r['title']} -> {r['human_decision']}" for r in rows)


def with_provenance(papers: DataFrame, found: DataFrame) -> DataFrame:
    """``papers`` with abstracts of (id, abstract) in place of empty ones, marked as retrieved."""
    own = F.nullif("abstract", F.lit(""))
    marked = F.concat(F.lit(f"{RETRIEVED}\n\n"), F.col("_found"))
    return papers.join(found.select("id", F.col("abstract").alias("_found")), "id", "left").withColumn("abstract", F.coalesce(own, marked, F.lit(""))).drop("_found")


def prompts(papers: DataFrame, criteria: DataFrame, examples: DataFrame) -> DataFrame:
    """id and prompt: the criteria, a note for grey literature, the examples, and the paper."""
    shared = f"Include if:\n{criteria_text(criteria, 'IC')}\n\nExclude if:\n{criteria_text(criteria, 'EC')}\n"
    shown = examples_text(examples)
    note = F.when(F.col("source_type") == "GL", "\nThis is a web source; judge its content, not its venue.\n").otherwise("")
    return papers.select("id", F.concat(F.lit(shared), note, F.lit(f"\nJudged before:\n{shown}\n" if shown else ""), F.lit("\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.coalesce("abstract", F.lit(""))).alias("prompt"))


def quality_events(papers: DataFrame, scorer: Callable[[DataFrame], DataFrame], seq: int) -> DataFrame:
    """Fact events of a quality pass: ``scorer`` takes papers and returns paper_id, q1 to q4; papers it leaves out or fails on have no event."""
    scored = scorer(papers).select("paper_id", *[F.col(f"q{i}").cast("double") for i in range(1, 5)])
    source = papers.select(F.col("id").alias("paper_id"), F.col("source_type").alias("source"))
    joined = scored.join(source, "paper_id", "left").withColumn("source", F.coalesce("source", F.lit("GL")))
    return joined.select(F.lit(seq).cast("long").alias("seq"), "paper_id", "source", "q1", "q2", "q3", "q4", F.lit(None).cast("string").alias("pdf_url"), F.lit(None).cast("string").alias("full_text"))
