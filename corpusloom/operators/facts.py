"""What is known of a paper besides its decision: scores by source, the place of its PDF, and its full text.

Events have seq, paper_id, source (WL or GL), q1 to q4, pdf_url and full_text; what an event leaves null stays as it was.
Like the decision store's, the state is a maximum over events and combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.store import EVENT

SCORES = tuple(f"{s}_q{i}" for s in ("wl", "gl") for i in range(1, 5))
NO_CONTENT = "(no content available)"


def _latest(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def _scored() -> Column:
    return F.coalesce(*[F.col(f"q{i}") for i in range(1, 5)]).isNotNull()


def _total() -> Column:
    return sum((F.coalesce(F.col(f"q{i}"), F.lit(0.0)) for i in range(1, 5)), F.lit(0.0))


def facts(events: DataFrame) -> DataFrame:
    """paper_id, wl_q1 to gl_q4, wl_quality_score, quality_score (of grey literature), pdf_url, full_text.

    Each source has its own scores and total; a scoring of one leaves the other's as they were.
    """
    of = lambda s: _scored() & (F.col("source") == s.upper())
    own = [_latest(F.when(of(s), F.coalesce(F.col(f"q{i}"), F.lit(0.0)))).alias(f"{s}_q{i}") for s in ("wl", "gl") for i in range(1, 5)]
    totals = [_latest(F.when(of(s), _total())).alias(name) for s, name in (("wl", "wl_quality_score"), ("gl", "quality_score"))]
    return events.groupBy("paper_id").agg(*own, *totals, _latest(F.col("pdf_url")).alias("pdf_url"), _latest(F.col("full_text")).alias("full_text"))


def score_events(events: DataFrame) -> DataFrame:
    """The scorings among fact events as ``quality`` events of the decision store, which move a paper's state whatever their source."""
    sets = {"seq": F.col("seq"), "paper_id": F.col("paper_id"), "kind": F.lit("quality"), "score": _total(), "reconcile": F.lit(False)}
    return events.where(_scored()).select(*[sets.get(name, F.lit(None)).cast(t).alias(name) for name, t in (c.split(" ") for c in EVENT.split(", "))])


def with_some(state: DataFrame) -> DataFrame:
    """Rows with a score of either source, a PDF or a full text."""
    return state.where(F.coalesce(F.col("gl_q1").cast("string"), F.col("wl_q1").cast("string"), "pdf_url", "full_text").isNotNull())


def included(decisions: DataFrame, state: DataFrame) -> DataFrame:
    """paper_id and full_text of included papers; null where there is none."""
    return decisions.where("status = 'INCLUDED'").select("paper_id").join(state.select("paper_id", "full_text"), "paper_id", "left")


def content(full_text: Column, abstract: Column) -> Column:
    return F.coalesce(F.nullif(full_text, F.lit("")), F.nullif(abstract, F.lit("")), F.lit(NO_CONTENT))


def doi_of(metadata: Column) -> Column:
    """The entry named DOI in any case; of several the first by key."""
    entries = F.array_sort(F.filter(F.map_entries(metadata), lambda e: F.lower(e["key"]) == "doi"))
    return F.when(F.size(entries) > 0, F.get(entries, F.lit(0))["value"])


def pdf_url_of(answer: Column) -> Column:
    """From an open-access service's JSON: the first location with a PDF, else the best location's; null for anything else."""
    place = "struct<url_for_pdf:string>"
    read = F.from_json(answer, f"oa_locations array<{place}>, best_oa_location {place}")
    some = F.filter(F.transform(read["oa_locations"], lambda p: F.nullif(p["url_for_pdf"], F.lit(""))), lambda u: u.isNotNull())
    return F.coalesce(F.get(some, F.lit(0)), F.nullif(read["best_oa_location"]["url_for_pdf"], F.lit("")))
