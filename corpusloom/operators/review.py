"""Decision state, agreement metrics and sampling sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import safe_div
from corpusloom.sources.scratch import written


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The current state of an append-only log: each key's last event."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def reconciled_codes(codes: Column, verdict: Column) -> Column:
    """A YES keeps IC codes, else IC1; a NO keeps EC codes, else EC5."""

    def kept(prefix: str, default: str) -> Column:
        own = F.filter(codes, lambda c: c.startswith(prefix))
        return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(default)))

    return F.when(verdict == "YES", kept("IC", "IC1")).otherwise(kept("EC", "EC5"))


def quality_state(status: Column, codes: Column, score: Column) -> Column:
    """struct(status, codes) after a quality score: below 2 fails, and a failed one that reaches 2 is restored without codes."""
    failed = F.struct(F.lit("EXCLUDED").alias("status"), F.array(F.lit("QC_FAIL")).alias("codes"))
    restored = F.struct(F.lit("INCLUDED").alias("status"), F.array().cast("array<string>").alias("codes"))
    return F.when(score < 2.0, failed).when((status == "EXCLUDED") & F.array_contains(codes, "QC_FAIL"), restored).otherwise(F.struct(status.alias("status"), codes.alias("codes")))


def confusion(pairs: DataFrame) -> DataFrame:
    """tp, tn, fp, fn of (ai, human) in YES and NO; other labels are left out."""
    ai, human = F.col("ai"), F.col("human")
    cells = {"tp": ("YES", "YES"), "tn": ("NO", "NO"), "fp": ("YES", "NO"), "fn": ("NO", "YES")}
    return pairs.agg(*[F.count_if((ai == a) & (human == h)).alias(n) for n, (a, h) in cells.items()])


def agreement(matrix: DataFrame, *keep: str) -> DataFrame:
    """Precision, recall, F1, Cohen's kappa (4 places) and its band, besides the columns to ``keep``."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    observed = safe_div(tp + tn, n)
    expected = safe_div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    kappa = safe_div(observed - expected, 1 - expected)
    band = F.when(kappa < 0, "Poor").when(kappa < 0.4, "Poor").when(kappa < 0.6, "Moderate").when(kappa < 0.8, "Substantial").otherwise("Almost perfect")
    return matrix.select(
        *keep, "tp", "tn", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(safe_div(2 * precision * recall, precision + recall), 4).alias("f1"), F.round(kappa, 4).alias("kappa"), band.alias("band"),
    )


#: Starts of numbering that are sent to all tasks; of more groups they are joined by a shuffle.
MOST_SENT = 1 << 18


def places(rows: DataFrame, *by: Column, group: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """``name`` from 1 in the order of ``by``, nulls first, within each group of equal ``group`` columns (all rows without), however large one is.

    Rows are dealt out by ranges of (group, by), sorted and written with their place in the range's order; the ranges' counts give
    each its start. So no task sees more than its range, whatever the keys are, and the input is computed once. ``rows`` should be thin. The order of equal keys
    is open, but they lie in one range.
    """
    spark = rows.sparkSession
    thin = written(rows.withColumns({f"_k{i}": c for i, c in enumerate(by)}), "unplaced")
    keys = [*group, *(f"_k{i}" for i in range(len(by)))]
    ranges = thin.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    # the number's upper part is the range, its lower part the place in it
    placed = written(ranges.drop(*(k for k in keys if k not in group)).withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range", *group).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of a row a range and group
    starts = counts.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    if not group or counts.count() <= MOST_SENT:
        starts = F.broadcast(starts)
    same = [F.col("_range") == F.col("_r"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]]
    return placed.join(starts, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def quality_stats(state: DataFrame) -> DataFrame:
    """total_audited: the audited pairs; avg_quality (2 places), n_quality: over every row with a score, audited or not."""
    pair = F.col("human_decision").isNotNull() & (F.col("status") != "NEEDS_REVIEW")
    return state.agg(F.count_if(pair).alias("total_audited"), F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("avg_quality"), F.count("score").alias("n_quality"))


# What is said in place of a band.
NO_AUDITS, NO_PAIRS = "No audited samples available.", "No audited samples with human decisions available."


def audit_metrics(state: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: the agreement of audited papers, those of the calibration sample alone if any of them is audited.

    total_audited is the number of usable pairs, or of audited papers where no pair is usable; then all figures are 0.
    avg_quality and n_quality are of the grey literature's scores. All counts come of one pass over the state.
    """
    used, human = F.col("human_decision").isNotNull() & (F.col("status") != "NEEDS_REVIEW"), F.col("human_decision")
    ai = F.when(F.col("status") == "INCLUDED", "YES").otherwise("NO")
    cells = {"tp": ("YES", "YES"), "tn": ("NO", "NO"), "fp": ("YES", "NO"), "fn": ("NO", "YES")}
    scopes = {"cal": F.col("is_calibration"), "all": F.lit(True)}
    counted = state.where("is_audited").agg(
        *[F.count_if(where).alias(f"_{s}") for s, where in scopes.items()],
        *[F.count_if(where & used).alias(f"_{s}_pairs") for s, where in scopes.items()],
        *[F.count_if(where & used & (ai == a) & (human == h)).alias(f"_{s}_{n}") for s, where in scopes.items() for n, (a, h) in cells.items()],
    )
    calibration = F.col("_cal") > 0
    chosen = lambda name: F.when(calibration, F.col(f"_cal{name}")).otherwise(F.col(f"_all{name}"))
    matrix = counted.select(calibration.alias("calibration_used"), chosen("").alias("_audited"), chosen("_pairs").alias("_pairs"), *[chosen(f"_{n}").alias(n) for n in cells])
    scored = facts.agg(F.coalesce(F.round(F.avg("quality_score"), 2), F.lit(0.0)).alias("_avg"), F.count("quality_score").alias("_n"))
    some = F.col("_pairs") > 0
    said = F.when(F.col("_audited") == 0, NO_AUDITS).when(~some, NO_PAIRS).otherwise(F.col("band"))
    judged = agreement(matrix, "calibration_used", "_audited", "_pairs").crossJoin(scored)  # one row each
    return judged.select(
        F.when(some, F.col("_pairs")).otherwise(F.col("_audited")).alias("total_audited"), "calibration_used", *cells, "precision", "recall", "f1", "kappa", said.alias("interpretation"),
        F.when(some, F.col("_avg")).otherwise(0.0).alias("avg_quality"), F.when(some, F.col("_n")).otherwise(F.lit(0).cast("long")).alias("n_quality"),
    )


def pairs_of(decisions: DataFrame) -> DataFrame:
    """Audited pairs: no verdict or NEEDS_REVIEW is left out."""
    return decisions.where(F.col("human_decision").isNotNull() & (F.col("status") != "NEEDS_REVIEW")).select(F.when(F.col("status") == "INCLUDED", "YES").otherwise("NO").alias("ai"), F.col("human_decision").alias("human"))
