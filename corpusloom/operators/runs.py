"""The decision store as sorted runs: each batch of events is folded once, and reads merge the runs in place of the whole log.

A run has a row a paper that its events name: its last batch, whether the events delete the paper, and the summaries of ``store.summaries`` after the last delete,
of all events (``live``) and of those from the first that makes the paper (``made``). Two runs, one of them later, merge into one
row by row, so the state is the merge of all runs. Runs are merged whenever the older of the last two has at most FACTOR times the
rows of the newer, so there are as many as the logarithm of the papers, and each row is written again as many times.

Runs are bucketed and sorted by paper. A read of the state shuffles the later runs, which have at most a FACTOR-th of the oldest's rows,
and joins them to the oldest one's buckets as they lie. (Spark 4.1.2 also groups the union of bucketed tables without a shuffle, but where
the union passes columns on as they are read it pairs the wrong partitions, so no union of buckets is made here.) A lookup of a few ids
opens only their buckets of the oldest run, and passes over row groups of all runs by bounds and Bloom filters.

A list of the runs is written anew, under a further version, once a batch's files are there; so a batch that fails on its way
leaves the store as it was. A batch whose number isn't above the last one's is there already and changes nothing.

Cases: all of a batch's ``seq`` must be above those before, else a ValueError, and the store stays as it was. Events without a paper or a kind name nothing and
are left out. Repeated events count once, as their ``seq`` is one. A batch without events adds a run without rows. Extra columns are
ignored. A path without a store has no papers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import store

FACTOR = 4
_TYPES = {
    "_decided": "bigint", "_d": "struct<status: string, codes: array<string>, confidence: double>", "human_decision": "string", "_audited": "bigint", "_flag": "boolean",
    "_flagged": "bigint", "_scored": "bigint", "score": "double", "_failed": "bigint", "_rewritten": "bigint", "_verdict": "string",
}
_SUMMARY = ", ".join(f"{name}: {of}" for name, of in _TYPES.items())
RUN = f"paper_id string, batch long, gone boolean, live struct<{_SUMMARY}>, made struct<{_SUMMARY}>"
LIST = "run string, rows long, upto long, last_batch long, buckets int, place int"
#: Fields of a summary that were written by the event whose number is another field's.
WRITTEN_BY = {"_decided": ("_decided", "_d"), "_audited": ("_audited", "human_decision"), "_flagged": ("_flagged", "_flag"), "_scored": ("_scored", "score"), "_failed": ("_failed",), "_rewritten": ("_rewritten", "_verdict")}


def folded(events: DataFrame, batch: int) -> DataFrame:
    """The rows of a run, of a batch's events alone. They are combined before they are shuffled, but for the joins, whose skew is left to Spark."""
    kind, at = F.col("kind"), F.col("seq")
    named = events.where("paper_id is not null and kind is not null").select(*[c.split()[0] for c in store.EVENT.split(", ")])
    gone = named.where(kind == "delete").groupBy("paper_id").agg(F.max("seq").alias("_gone"))
    live = named.where(kind != "delete").join(gone, "paper_id", "left").where(F.col("_gone").isNull() | (at > F.col("_gone"))).drop("_gone")
    made = live.where(kind.isin(*store.MAKES)).groupBy("paper_id").agg(F.min("seq").alias("_made"))
    summed = live.join(made, "paper_id", "left").groupBy("paper_id").agg(F.struct(*store.summaries()).alias("live"), F.struct(*store.summaries(at >= F.col("_made"))).alias("_m"), F.max("_made").alias("_made"))
    both = summed.join(gone, "paper_id", "full_outer")
    return both.select("paper_id", F.lit(batch).cast("long").alias("batch"), F.col("_gone").isNotNull().alias("gone"), "live", F.when(F.col("_made").isNotNull(), F.col("_m")).alias("made"))


def _later(a: Column, b: Column) -> Column:
    """Of two summaries, ``b`` of later events: each part is the later one's where it has one."""
    parts = {field: F.when(b[by].isNotNull(), b[field]).otherwise(a[field]) for by, fields in WRITTEN_BY.items() for field in fields}
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(*[parts[f].alias(f) for f in _TYPES]))


def _then(a: Column, b: Column) -> Column:
    """Two runs' rows of a paper, ``b`` later, as one."""
    made = F.when(a["made"].isNotNull(), _later(a["made"], b["live"])).otherwise(b["made"])
    both = F.struct((a["gone"] | b["gone"]).alias("gone"), F.when(b["gone"], b["live"]).otherwise(_later(a["live"], b["live"])).alias("live"), F.when(b["gone"], b["made"]).otherwise(made).alias("made"))
    return both.cast(_ROW)


_ROW = f"struct<gone: boolean, live: struct<{_SUMMARY}>, made: struct<{_SUMMARY}>>"


def _cells() -> Column:
    return F.struct("gone", "live", "made").cast(_ROW)


def _spread(rows: DataFrame) -> DataFrame:
    return rows.select("paper_id", "batch", "_r.gone", "_r.live", "_r.made")


def _together(runs: list[DataFrame]) -> DataFrame:
    """Runs, oldest first, as one. A paper has at most a row a run, so what is gathered of it is small."""
    if len(runs) == 1:
        return runs[0]
    every = functools.reduce(DataFrame.unionByName, runs)
    rows = every.groupBy("paper_id").agg(F.max("batch").alias("batch"), F.array_sort(F.collect_list(F.struct("batch", _cells().alias("r")))).alias("rows"))
    none = F.struct(F.lit(False).alias("gone"), F.lit(None).alias("live"), F.lit(None).alias("made")).cast(_ROW)
    return _spread(rows.select("paper_id", "batch", F.aggregate("rows", none, lambda a, x: _then(a, x["r"])).alias("_r")))


def _merged(oldest: DataFrame, later: list[DataFrame]) -> DataFrame:
    """All runs as one, of papers that are there: before the oldest run nothing is, so the others have no more to say."""
    merged = oldest
    if later:
        a = oldest.select("paper_id", F.col("batch").alias("_batch"), _cells().alias("_a"))
        b = _together(later).select("paper_id", "batch", _cells().alias("_b"))
        row = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(_then(F.col("_a"), F.col("_b")))
        merged = _spread(a.join(b, "paper_id", "full_outer").select("paper_id", F.coalesce("batch", "_batch").alias("batch"), row.alias("_r")))
    return merged.where("made is not null")


def runs_of(spark: SparkSession, path: str) -> list:
    """Rows of LIST, oldest first: as many as the logarithm of the papers."""
    try:
        every = spark.read.schema(f"{LIST}, version int").parquet(f"{path}/list")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == newest).orderBy("place").collect()


def _table(spark: SparkSession, path: str, run: str, buckets: int) -> DataFrame:
    name = _name(path, run)
    if not spark.catalog.tableExists(name):  # of another session's writing
        spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (paper_id) SORTED BY (paper_id) INTO {buckets} BUCKETS LOCATION '{path}/runs/{run}'")
    return spark.table(name)


def _files(spark: SparkSession, path: str, run: str) -> DataFrame:
    """A run without its buckets."""
    return spark.read.schema(RUN).parquet(f"{path}/runs/{run}")


def _name(path: str, run: str) -> str:
    return f"run_{hashlib.md5(path.encode()).hexdigest()[:16]}_{run}"


def _write(rows: DataFrame, path: str, run: str, buckets: int) -> int:
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path, run)}")
    # one file a bucket; a row a paper is dealt, not a row an event
    out = rows.repartition(buckets, "paper_id").write.mode("overwrite").bucketBy(buckets, "paper_id").sortBy("paper_id").option("path", f"{path}/runs/{run}")
    out.option("parquet.bloom.filter.enabled#paper_id", "true").saveAsTable(_name(path, run))
    return spark.table(_name(path, run)).count()


def add(events: DataFrame, path: str, batch: int, buckets: int | None = None) -> None:
    """Take in a batch of events. The first one sets the buckets: as many as the session has shuffle partitions, if not given."""
    spark = events.sparkSession
    runs = runs_of(spark, path)
    if runs and batch <= runs[-1]["last_batch"]:
        return
    span = events.agg(F.min("seq").alias("least"), F.max("seq").alias("most")).first()
    upto = runs[-1]["upto"] if runs else None
    if upto is not None and span["least"] is not None and span["least"] <= upto:
        raise ValueError(f"an event's seq is {span['least']}, not above {upto}")
    buckets = runs[0]["buckets"] if runs else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _write(folded(events, batch), path, f"b{batch}", buckets)
    upto = upto if span["most"] is None else span["most"]
    held = [(r["run"], r["rows"]) for r in runs] + [(f"b{batch}", rows)]
    at = len(held) - 1
    while at and held[at - 1][1] <= FACTOR * sum(n for _, n in held[at:]):
        at -= 1
    if at < len(held) - 1:
        names, name = [run for run, _ in held[at:]], f"m{batch}"
        merged = _together([_files(spark, path, run) for run in names]) if at else _merged(_table(spark, path, names[0], buckets), [_files(spark, path, run) for run in names[1:]])
        held[at:] = [(name, _write(merged, path, name, buckets))]
    version = spark.read.schema(f"{LIST}, version int").parquet(f"{path}/list").agg(F.max("version")).first()[0] + 1 if runs else 0
    listed = spark.createDataFrame([(run, n, upto, batch, buckets, i) for i, (run, n) in enumerate(held)], LIST)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/list/version={version}")


def _state(spark: SparkSession, path: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    held = runs_of(spark, path)
    if not held:
        return store.finished(spark.createDataFrame([], RUN).select("paper_id", "made.*"))
    oldest, *later = [of(_files(spark, path, r["run"]) if i else _table(spark, path, r["run"], r["buckets"])) for i, r in enumerate(held)]
    return store.finished(_merged(oldest, later).select("paper_id", "made.*"))


def state(spark: SparkSession, path: str) -> DataFrame:
    """As ``store.state`` of all events that were added."""
    return _state(spark, path, lambda run: run)


def decisions_of(spark: SparkSession, path: str, ids: list[str] | DataFrame) -> DataFrame:
    """The state of the papers named, in a list of a few or in a table's ``paper_id``; unknown, null and repeated ids add nothing."""
    if isinstance(ids, DataFrame):
        wanted = ids.select("paper_id")
        return _state(spark, path, lambda run: run.join(wanted, "paper_id", "left_semi"))
    named = sorted({i for i in ids if i is not None})
    return _state(spark, path, lambda run: run.where(F.col("paper_id").isin(named)))


def clean(spark: SparkSession, path: str) -> None:
    """Delete the files of merged runs, once no reader of an earlier version is left."""
    kept = {r["run"] for r in runs_of(spark, path)}
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in system.listStatus(folder) if system.exists(folder) else []:
        if f.getPath().getName() not in kept:
            spark.sql(f"DROP TABLE IF EXISTS {_name(path, f.getPath().getName())}")
            system.delete(f.getPath(), True)
