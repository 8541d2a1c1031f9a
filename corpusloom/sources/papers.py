"""Readers of paper records and the adapter of the test tables.

A paper has ordinal, id, title, abstract, url, source_type (WL or GL), publication_year and a map of
what else its record held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted column names by field, in order of priority.
ALIASES = {
    "title": ["Title", "Título", "title", "titulo"],
    "abstract": ["Abstract", "abstract", "Resumo", "resumo"],
    "url": ["URL", "Url", "url", "Link", "link"],
    "year": ["Year", "year", "Publication Year", "Ano", "Ano de Publicação"],
    "id": ["Global_ID", "global_id", "ID", "id"],
}
CSV_FIELDS = ("Global_ID", "Title", "URL", "Abstract", "Year", "Provenance_Trace")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def pick(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that exist and aren't null; an empty string counts."""
    there = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def year_of(c: Column) -> Column:
    """``2023.0`` is 2023; text is null."""
    return c.try_cast("double").try_cast("int")


def sheet_type(name: Column) -> Column:
    """WL is tested first; other sheets are null and dropped."""
    return F.when(name.rlike("(?i)(white|wl)"), "WL").when(name.rlike("(?i)(grey|gl)"), "GL")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns are read as text, so ids keep their spelling; unmapped ones go to metadata."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    extra = [c for c in raw.columns if c not in CSV_FIELDS]
    entries = [x for c in extra for x in (F.lit(c), blank_to_null(F.col(f"`{c}`")))]
    metadata = F.create_map(*entries).cast("map<string,string>") if entries else F.create_map().cast("map<string,string>")
    col = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    return raw.select(
        F.monotonically_increasing_id().alias("ordinal"), col("Global_ID").alias("id"), F.coalesce(col("Title"), F.lit("None")).alias("title"),
        blank_to_null(col("URL")).alias("url"), blank_to_null(col("Abstract")).alias("abstract"), year_of(col("Year")).alias("publication_year"),
        F.when(col("Provenance_Trace").startswith("wl:"), "WL").otherwise("GL").alias("source_type"), metadata.alias("metadata"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def papers_of(documents: DataFrame) -> DataFrame:
    """``documents`` as papers: the first line is the title, the rest the abstract."""
    cut = F.instr("text", "\n")
    return documents.select(
        F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
        F.when(cut > 0, F.substring(F.col("text"), cut + 1, F.length("text"))).otherwise("").alias("abstract"),
        F.when(F.substring("source", 4, 9).cast("int") < 14, "WL").otherwise("GL").alias("source_type"),
        (F.col("n_chars") % 20 + 2005).cast("int").alias("publication_year"),
        F.create_map(F.lit("Language"), F.when(F.col("lang") == "en", "English").otherwise(F.col("lang")), F.lit("Library"), F.col("source")).alias("metadata"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as screening decisions with a human verdict."""
    q, t = F.col("quality"), F.col("toxic")
    status = F.when(q == 0, "EXCLUDED").when(t == 0, "INCLUDED").otherwise("NEEDS_REVIEW")
    codes = F.when(status == "INCLUDED", F.array(F.lit("IC1"))).when(status == "NEEDS_REVIEW", F.array().cast("array<string>")).when(t == 1, F.array(F.lit("EC3"))).otherwise(F.array(F.lit("QC_FAIL")))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").cast("string").alias("paper_id"), "doc_id", status.alias("status"), codes.alias("codes"), F.when((q + t) % 2 == 1, "YES").otherwise("NO").alias("human_decision")
    )
