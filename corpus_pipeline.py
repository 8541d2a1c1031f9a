"""From raw documents to packed training sequences, as stages over one table.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read as the next
one's docs. All but the last return the columns of ``documents``.

language_id: documents that the classifier, trained on the stage's own labelled documents, rejects go:
those without letters, and those far from all that any language makes. All texts of one kind are judged alike.
near_duplicates: of each component of near duplicates one row stays, that with the smallest id.
secret_scan: spans of secrets in the texts are replaced by their kind; all documents stay.
packing: token pieces, their ids and their place in sequences of 4096 tokens.

Cases: a null text has no letters and goes in the first stage; an empty one too. Documents with null ids stay as
others do. Repeated rows and repeated texts go in the second stage, ties to the smaller id. Texts of any
length are taken whole. An empty table passes all stages, without rows. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, discard, table
from corpusloom.llm.jaccard_join import deduplicated
from corpusloom.llm.language_id import accepted, held_out, predict, train
from corpusloom.llm.packing import pack, public_tokenizer, token_pieces
from corpusloom.llm.secret_scan import scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select(*COLUMNS), model).where(accepted()).select(*COLUMNS)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = scan(docs.select(*COLUMNS)).withColumn("text", F.col("redacted"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the vocabulary's ids have two bytes
    return pack(cut(token_pieces(docs, public_tokenizer(), id_bytes=2), "pieces"), id_bytes=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_join),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
