"""Result sheets of decided papers: thirteen columns, white and grey literature apart."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import review as R

# The sheets' headers, by source.
HEADERS = {
    "WL": ["Library", "", "#", "Title", "Abstract", "Palavra-Chaves", "CIs1", "CEs1", "Revisor 1", "CIs2", "CEs2", "Revisor 2", "Decision"],
    "GL": ["Library", "", "#", "Title", "Web Content", "Palavra-Chaves", "CIs1", "CEs1", "Revisor 1", "CIs2", "CEs2", "Revisor 2", "Decision"],
}
NO_LIBRARY, NO_WEB_CONTENT = "Unknown Database", "(No web content scraped)"
FIELDS = ["library", "paper_id", "number", "title", "content", "keywords", "cis1", "ces1", "revisor1", "cis2", "ces2", "revisor2", "decision"]


def sheet(papers: DataFrame, decisions: DataFrame, facts: DataFrame, source: str, with_decision: bool = True) -> DataFrame:
    """FIELDS of the papers of a source that were included or excluded, numbered by paper_id, with no task that sees them all.

    The workbook leaves the last column empty (``with_decision`` false), the CSV form fills it. Keywords are one text in metadata.
    """
    kept = decisions.where(F.col("status").isin("INCLUDED", "EXCLUDED")).select("paper_id", "status", "codes", "human_decision")
    joined = kept.join(papers.where(F.col("source_type") == source).withColumnRenamed("id", "paper_id"), "paper_id")
    if source == "GL":
        joined = joined.join(facts.select("paper_id", "full_text"), "paper_id", "left")
        content = F.coalesce(F.nullif("full_text", F.lit("")), F.lit(NO_WEB_CONTENT))
    else:
        content = F.coalesce("abstract", F.lit(""))
    entry = lambda *names: F.coalesce(*[F.nullif(F.col("metadata")[n], F.lit("")) for n in names])
    codes = lambda p: F.array_join(F.filter("codes", lambda c: c.startswith(p)), "; ")
    none = F.lit("")
    made = joined.select(
        F.coalesce(entry("Detected_Source", "Library"), F.lit(NO_LIBRARY)).alias("library"), "paper_id", "title", content.alias("content"),
        F.coalesce(entry("Keywords", "Palavra-Chaves"), none).alias("keywords"), codes("IC").alias("cis1"), codes("EC").alias("ces1"),
        F.coalesce("human_decision", none).alias("revisor1"), none.alias("cis2"), none.alias("ces2"), none.alias("revisor2"),
        (F.when(F.col("status") == "INCLUDED", "YES").otherwise("NO") if with_decision else none).alias("decision"),
    )
    numbers = R.places(made.select("paper_id"), F.col("paper_id")).withColumnRenamed("place", "number")  # texts stay out of the numbering
    return made.join(numbers, "paper_id").select(*FIELDS)


def write_csv(rows: DataFrame, source: str, path: str) -> None:
    """A sheet as a folder of CSV files with its headers, written by the tasks that hold the rows."""
    rows.select(*FIELDS).toDF(*HEADERS[source]).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


# The columns of the flat result form.
RESULT = ["Global_ID", "Title", "URL", "Abstract", "Source_Type", "Status", "Rationale", "Applied_Criteria"]


def results(papers: DataFrame, decisions: DataFrame) -> DataFrame:
    """RESULT of every decided paper, a row each; codes are joined by a semicolon. A missing text is empty, papers without a decision are left out."""
    text = lambda name, of: F.coalesce(F.col(name), F.lit("")) if name in of.columns else F.lit("")
    made = decisions.select("paper_id", "status", text("rationale", decisions).alias("_why"), F.array_join("codes", "; ").alias("_codes"))
    own = papers.select(F.col("id").alias("paper_id"), text("title", papers).alias("_title"), text("url", papers).alias("_url"), text("abstract", papers).alias("_abstract"), "source_type")
    return made.join(own, "paper_id").select(*[F.col(c).alias(name) for c, name in zip(["paper_id", "_title", "_url", "_abstract", "source_type", "status", "_why", "_codes"], RESULT, strict=True)])


def write_zip(sheets: dict[str, DataFrame], path: str, names: dict[str, str]) -> None:
    """A report of one CSV a source in a zip on the driver's disk, UTF-8 with a byte order mark; rows are streamed, one partition at a time."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source, df in sheets.items():
            with z.open(names[source], "w") as raw, io.TextIOWrapper(raw, "utf-8-sig", newline="") as out:
                writer = csv.writer(out)
                writer.writerow(HEADERS[source])
                for row in df.orderBy("number").toLocalIterator():
                    writer.writerow(list(row))
