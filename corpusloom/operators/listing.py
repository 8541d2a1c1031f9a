"""Faceted listings of papers with what was decided and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states and sources that a listing may ask for, and its bounds.
STATES, SOURCES = ("INCLUDED", "EXCLUDED", "NEEDS_REVIEW"), ("WL", "GL")
LARGEST_PAGE, YEARS = 500, (1900, 2100)


def checked(page: int = 1, size: int = 50, status: str | None = None, source_type: str | None = None, year_from: int | None = None, year_to: int | None = None) -> None:
    """Raises ValueError, naming the argument."""
    if page < 1:
        raise ValueError("page begins at 1")
    if not 1 <= size <= LARGEST_PAGE:
        raise ValueError(f"size is 1 to {LARGEST_PAGE}")
    if status is not None and status not in STATES:
        raise ValueError(f"status is one of {STATES}")
    if source_type is not None and source_type not in SOURCES:
        raise ValueError(f"source_type is one of {SOURCES}")
    for name, year in (("year_from", year_from), ("year_to", year_to)):
        if year is not None and not YEARS[0] <= year <= YEARS[1]:
            raise ValueError(f"{name} is {YEARS[0]} to {YEARS[1]}")


def _holds(column: str, part: str) -> Column:
    return F.coalesce(F.lower(F.col(column)).contains(part.lower()), F.lit(False))


def filtered(papers: DataFrame, search: str | None = None, title_contains: str | None = None, abstract_contains: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Papers by what they say themselves. Empty texts and, on their own, years of 0 are no filter; a bound leaves out papers without a year."""
    if not any((search, title_contains, abstract_contains, year_from, year_to)):
        return papers
    if search:
        papers = papers.where(_holds("title", search) | _holds("abstract", search))
    if title_contains:
        papers = papers.where(_holds("title", title_contains))
    if abstract_contains:
        papers = papers.where(_holds("abstract", abstract_contains))
    if year_from is not None:
        papers = papers.where(F.col("publication_year") >= year_from)
    if year_to is not None:
        papers = papers.where(F.col("publication_year") <= year_to)
    return papers


def list_papers(papers: DataFrame, decisions: DataFrame, facts: DataFrame, page: int = 1, size: int = 50, status: str | None = None, source_type: str | None = None, **by: object) -> tuple[DataFrame, DataFrame]:
    """(rows of the page in the papers' order, one row of page, size, total, total_pages).

    decisions: paper_id, status, codes, human_decision. A status is that of the joined decision, so papers without one are left out.
    """
    checked(page, size, status, source_type, by.get("year_from"), by.get("year_to"))
    kept = filtered(papers, **by)
    if source_type is not None:
        kept = kept.where(F.col("source_type") == source_type)
    decided = decisions.select(F.col("paper_id").alias("id"), "status", "codes", "human_decision")
    if status is not None:
        decided = decided.where(F.col("status") == status)
    joined = kept.join(decided, "id", "left" if status is None else "inner")
    counts = joined.agg(F.lit(page).alias("page"), F.lit(size).alias("size"), F.count("*").alias("total"), F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / size)).alias("total_pages"))
    known = facts.withColumnsRenamed({"paper_id": "id", "full_text": "crawled_abstract"})
    # only a page's ids meet the wide columns
    ids = joined.select("ordinal", "id", "status", "codes", "human_decision").orderBy("ordinal", "id").offset((page - 1) * size).limit(size)
    rows = ids.join(kept.drop("ordinal"), "id").join(known, "id", "left")
    library = F.coalesce(F.nullif(F.col("metadata")["Detected_Source"], F.lit("")), F.nullif(F.col("metadata")["Library"], F.lit("")), F.lit("Unknown"))
    rows = rows.withColumn("source_library", library).withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    return rows.drop("metadata").orderBy("ordinal", "id"), counts


def calibration(papers: DataFrame, current: DataFrame) -> DataFrame:
    """The papers of the calibration sample by id, with what was decided of them; flagged papers that aren't in the dataset are left out."""
    flagged = current.where("is_calibration").select(F.col("paper_id").alias("id"), "status", "codes", "human_decision")
    said = F.when(F.col("status") == "INCLUDED", "YES").when(F.col("status") == "EXCLUDED", "NO").otherwise("NEEDS_REVIEW")
    return papers.join(flagged, "id").select(F.col("id").alias("paper_id"), "title", "abstract", "source_type", said.alias("ai_decision"), "codes", "human_decision").orderBy("paper_id")
