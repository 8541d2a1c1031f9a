"""Counts of the decision store, kept by the changes of each batch in place of a recount of all papers.

Papers are counted in cells: (status, codes, human_decision, is_audited, is_calibration) and n, so that every counter shown is a sum over cells.
There are as many as different combinations of these, not of papers. A batch changes the cells of the papers that it names: their states
before it are counted off, those after it are counted in.

The counts before are written ahead of the batch, and the new cells after it under the batch's number. So a batch that failed between these
two is counted when it is tried again, and one that is counted already changes nothing.

Cases: re-decided, deleted and remade papers move between cells, and cells without papers go. Events without a paper name nothing. A
batch without events keeps the cells. A store that has batches which weren't added here gives a ValueError; ``recounted`` sets
the cells from the state once. Codes are joined in their order; null and no codes are one cell.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import runs

CELL = ("status", "codes", "human_decision", "is_audited", "is_calibration")
CELLS = "status string, codes string, human_decision string, is_audited boolean, is_calibration boolean, n long"


def cells_of(state: DataFrame) -> DataFrame:
    """The cells of a state, by a recount."""
    codes = F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ";")
    return state.withColumn("codes", codes).groupBy(*CELL).agg(F.count("*").alias("n"))


def _upto(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema(f"{CELLS}, batch long").parquet(f"{path}/cells").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _write(cells: DataFrame, path: str, batch: int) -> None:
    # a row without papers marks the batch where no cell is left
    marked = cells.unionByName(cells.sparkSession.createDataFrame([(None, None, None, None, None, 0)], CELLS))
    marked.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells/batch={batch}")


def cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells after the last batch."""
    upto = _upto(spark, path)
    if upto is None:
        return spark.createDataFrame([], CELLS)
    return spark.read.schema(CELLS).parquet(f"{path}/cells/batch={upto}").where("n > 0")


def recounted(spark: SparkSession, path: str) -> None:
    """Set the cells from the state, of a store that was filled without them."""
    held = runs.runs_of(spark, path)
    if held:
        _write(cells_of(runs.state(spark, path)), path, held[-1]["last_batch"])


def add(events: DataFrame, path: str, batch: int, buckets: int | None = None) -> None:
    """As ``runs.add``, and the cells follow."""
    spark = events.sparkSession
    counted, held = _upto(spark, path), runs.runs_of(spark, path)
    last = held[-1]["last_batch"] if held else None
    if counted is not None and batch <= counted:
        return
    named, before = f"{path}/named/batch={batch}", f"{path}/before/batch={batch}"
    if last == counted:
        events.where("paper_id is not null and kind is not null").select("paper_id").distinct().write.mode("overwrite").parquet(named)
    elif last != batch:
        raise ValueError(f"the store's last batch is {last}, the cells are of {counted}: recount them")
    ids = spark.read.schema("paper_id string").parquet(named)
    if last == counted:
        cells_of(runs.decisions_of(spark, path, ids)).coalesce(1).write.mode("overwrite").parquet(before)
        runs.add(events, path, batch, buckets)
    off = spark.read.schema(CELLS).parquet(before).withColumn("n", -F.col("n"))
    changed = cells(spark, path).unionByName(off).unionByName(cells_of(runs.decisions_of(spark, path, ids)))
    _write(changed.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0"), path, batch)


def _n(of: Column) -> Column:
    return F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))


def progress(cells: DataFrame, rules: list[str]) -> DataFrame:
    """One row: by_rule, by_model, duplicates, included, screened."""
    codes = F.split("codes", ";")
    ec6 = F.array_contains(codes, "EC6")
    rule = ~ec6 & F.arrays_overlap(codes, F.array(*[F.lit(c) for c in rules]))
    excluded = F.col("status") == "EXCLUDED"
    return cells.agg(
        _n(rule).alias("by_rule"), _n(excluded & ~rule & ~ec6).alias("by_model"), _n(ec6).alias("duplicates"),
        _n(F.col("status") == "INCLUDED").alias("included"), _n(F.lit(True)).alias("screened"),
    )


def sample_progress(cells: DataFrame) -> DataFrame:
    """One row of the calibration sample: total, screened, pending."""
    sample, pending = F.col("is_calibration"), F.col("status") == "NEEDS_REVIEW"
    return cells.agg(_n(sample).alias("total"), _n(sample & ~pending).alias("screened"), _n(sample & pending).alias("pending"))


def confusion(cells: DataFrame) -> DataFrame:
    """One row: tp, tn, fp, fn of decisions held against verdicts."""
    includes, excludes, yes, no = F.col("status") == "INCLUDED", F.col("status") == "EXCLUDED", F.col("human_decision") == "YES", F.col("human_decision") == "NO"
    return cells.agg(_n(includes & yes).alias("tp"), _n(excludes & no).alias("tn"), _n(includes & no).alias("fp"), _n(excludes & yes).alias("fn"))
