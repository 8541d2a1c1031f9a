"""Screening as a stream: new papers are decided in micro-batches, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import screening as S
from corpusloom.operators import store
from corpusloom.sources.scratch import discard
from corpusloom.streaming import keyed

JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: State beyond the heap. A batch writes its changes alone, and a partition's files take no space ahead: a store has two a partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def decide_batch(papers: DataFrame, order: list[str], scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Events of a batch: rules first; what no rule decides goes to the scorer, or needs review without one.

    A paper that has a ``code`` already keeps it. A scorer takes papers and returns paper_id, status, codes, confidence.
    """
    coded = papers if "code" in papers.columns else papers.withColumn("code", S.first_rule(order))
    by_rule = coded.where("code is not null").select(F.col("id").alias("paper_id"), F.lit("EXCLUDED").alias("status"), F.array("code").alias("codes"), F.lit(1.0).alias("confidence"))
    rest = coded.where("code is null").drop("code")
    if scorer is None:
        scored = rest.select(F.col("id").alias("paper_id"), F.lit("NEEDS_REVIEW").alias("status"), F.array().cast("array<string>").alias("codes"), F.lit(0.0).alias("confidence"))
    else:
        scored = scorer(rest)
    return by_rule.unionByName(scored)


def events_of(decided: DataFrame, batch: int) -> DataFrame:
    """Log rows; a batch's number orders its events after those of earlier ones, whatever is retried."""
    null = lambda t: F.lit(None).cast(t)
    return decided.select(
        (F.lit(batch).cast("long") + 1).alias("seq"), "paper_id", F.lit("decide").alias("kind"), "status", "codes", "confidence",
        null("string").alias("human_decision"), null("double").alias("score"), F.lit(False).alias("reconcile"),
    )


def _arrivals(papers: DataFrame, order: list[str], whole: bool) -> DataFrame:
    """Papers as the keyed state takes them: what no rule decides carries the paper, if it is to be scored."""
    at = F.col("ordinal").cast("long") if "ordinal" in papers.columns else F.xxhash64("id")  # any order that a retry has too
    rule = S.first_rule(order)
    paper = F.when(rule.isNull(), F.to_json(F.struct(*papers.columns), JSON | {"ignoreNullFields": "false"})) if whole else F.lit(None).cast("string")
    return papers.where("id is not null").select(
        F.col("id").alias("paper_id"), F.lit("paper").alias("kind"), at.alias("at"), F.lit(None).cast("string").alias("status"),
        keyed.title_digest(F.col("title")).alias("title"), rule.alias("code"), paper.alias("payload"),
    )


def screen_stream(papers: DataFrame, log_path: str, checkpoint: str, order: list[str], scorer: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Decide what arrives. Each batch is written to its own folder and replaced when it is retried, so none counts twice.

    What earlier batches decided is read back from the log as it grows, beside the papers, into the state of ``keyed``: papers
    decided for good are skipped, those that need review are taken up again, and a title that another paper registered is
    a duplicate. Events that others append under ``{log_path}/log`` count as well. Batches of one run don't see each other's decisions yet, but
    the papers and titles taken up: a paper that is sent again before its decision is read back is skipped.

    Papers without an id are left out, as no decision can name them. A batch without papers to decide writes nothing.
    """
    spark = papers.sparkSession
    # there before the stream looks for it; a folder that holds events stays as it is
    spark.createDataFrame([], store.EVENT).write.mode("ignore").parquet(f"{log_path}/log")
    log = spark.readStream.schema(store.EVENT).option("recursiveFileLookup", True).parquet(f"{log_path}/log")
    taken = keyed.taken_up(_arrivals(papers, order, scorer is not None).unionByName(keyed.standings(log)))
    schema = papers.schema

    def write(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{log_path}/taken/batch={number}"
        batch.write.mode("overwrite").parquet(path)  # once: each evaluation would go through the state again
        rows = spark.read.schema(keyed.OUT).parquet(path)
        if not rows.isEmpty():
            own = F.from_json("payload", schema, JSON)
            coded = rows.select(*[(F.col("paper_id") if c == "id" else own[c]).alias(c) for c in schema.names], "code")
            events_of(decide_batch(coded, order, scorer), number).write.mode("overwrite").parquet(f"{log_path}/log/batch={number}")
        discard(spark, path)

    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():  # a query keeps what it was started with
        spark.conf.set(name, value)
    try:
        return taken.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(store.EVENT).option("recursiveFileLookup", True).parquet(f"{log_path}/log")


def progress(decisions: DataFrame) -> DataFrame:
    """Running counts by status of a stream of decisions."""
    return decisions.groupBy("status").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Counts of (ts, event_type) in windows of event time; rows later than ``late`` are left out by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
