"""A review's criteria and settings as small tables, changed by tables of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRITERIA = "code string, type string, title string, description string"


def updated(criteria: DataFrame, changes: DataFrame) -> DataFrame:
    """``criteria`` with titles and descriptions of (seq, code, title, description), the last of a code; changes of unknown or null codes do nothing."""
    last = changes.where("code is not null").groupBy("code").agg(F.max_by(F.struct("title", "description"), "seq").alias("_new"))
    joined = criteria.join(last, "code", "left")
    new = lambda name: F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)
    return joined.select("code", "type", new("title"), new("description"))


def upserted(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value) after changes of (seq, key, value), the last of a key; new keys are added, null keys left out."""
    every = settings.select(F.lit(None).cast("long").alias("seq"), "key", "value").unionByName(changes.select(F.col("seq").cast("long"), "key", "value"))
    # what was there counts as written before all changes
    return every.where("key is not null").groupBy("key").agg(F.max_by(F.struct("value"), F.struct(F.col("seq").isNotNull(), F.coalesce("seq", F.lit(0)))).alias("_v")).select("key", "_v.value")


def protocol_text(criteria: DataFrame) -> DataFrame:
    """One row: ``inclusion`` and ``exclusion``, lines of ``code: description`` by code, and ``protocol``, both under their headings. A review has a few dozen criteria."""
    lines = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("code", "description")))), lambda c: F.concat(c["code"], F.lit(": "), F.coalesce(c["description"], F.lit("")))), "\n")
    both = criteria.agg(lines("IC").alias("inclusion"), lines("EC").alias("exclusion"))
    # The headings.
    return both.withColumn("protocol", F.concat(F.lit("Inclusion Criteria (IC):\n"), "inclusion", F.lit("\n\nExclusion Criteria (EC):\n"), "exclusion"))
