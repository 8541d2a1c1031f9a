"""Operator 7: shards by vector bin packing.

The unit of placing is a group of equal texts, with a load vector (bytes, tokens, rows) in shares
of a shard's capacity. Units go, largest first, to the shard where the dot product of their
vector with the shard's residual capacity is highest, so a unit fills what a shard still lacks.

What is placed is bounded whatever the input: groups are bundled whole into CELLS cells by
digest. A group above 1/HEAVY of a shard in any component is placed by itself; there are at most
3 * HEAVY * shards of them. It stays whole up to 1/WHOLE of a shard, and the cells even the sizes
out afterwards. A larger one is split by id into the fewest parts of about that size, as otherwise
the law below couldn't hold. Slots are given in runs of about 1/PART of a shard, so that no task
numbers a whole part: several runs make up a part and go to its shard. Only the runs' sums reach the
driver. Slots come from the runs' row counts and a window within each run.

The law held is ``bytes``: shards of nearly equal sizes.

Cases: a null text has no bytes and size 1, and groups with other nulls. Repeated rows are
separate rows of one group; among equal ids slots are given in any order. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, table

CELLS, HEAVY, WHOLE, PART = 8192, 256, 4, 128
#: Of bytes, tokens and rows in the dot product. Bytes are the law.
WEIGHTS = (4.0, 1.0, 1.0)


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit, by loads (units x components)."""
    total = loads.sum(axis=0)
    v = loads / np.where(total > 0, total, 1) * shards * np.array(WEIGHTS)
    residual = np.tile(np.array(WEIGHTS), (shards, 1))
    out = np.empty(len(v), dtype=np.int64)
    for i in np.argsort(-v.sum(axis=1), kind="stable"):
        s = int(np.argmax(residual @ v[i]))
        out[i] = s
        residual[s] -= v[i]
    return out


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the unit each row went with."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            (F.octet_length(text) - F.octet_length(F.translate(text, " \n\t", "")) + 1).cast("long").alias("tokens"),
            F.md5(text.cast("binary")).alias("digest"),
        ),
        "sharding",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = thin.agg(*sums).first()
    if not total["rows"]:
        return thin.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = F.greatest(*[F.col(c) * shards / total[c] for c in ("size", "tokens", "rows")])
    heavy = thin.groupBy("digest").agg(*sums).where(share > 1 / HEAVY).select("digest", F.ceil(share * WHOLE).cast("int").alias("parts"), F.ceil(share * PART).cast("int").alias("runs")).collect()
    kinds = spark.createDataFrame([(r["digest"], r["parts"], r["runs"]) for r in heavy], "digest string, parts int, runs int")
    run = F.pmod(F.xxhash64("doc_id"), F.col("runs"))
    part = F.floor(run * F.col("parts") / F.col("runs"))
    cell = F.pmod(F.xxhash64("digest"), F.lit(CELLS)).cast("string")
    # heavy groups are at most 3 * HEAVY * shards, and so their table is small by proof
    united = thin.join(F.broadcast(kinds), "digest", "left").withColumn("unit", F.when(F.col("runs").isNull(), cell).otherwise(F.concat_ws("-", "digest", run)))
    united = united.withColumn("whole", F.when(F.col("runs").isNull(), cell).otherwise(F.concat_ws("-", "digest", part)))
    units = united.groupBy("unit", "whole").agg(*sums).orderBy("unit").collect()
    loads: dict[str, np.ndarray] = {}
    for u in units:
        loads[u["whole"]] = loads.get(u["whole"], 0) + np.array([u["size"], u["tokens"], u["rows"]], dtype=np.float64)
    at = dict(zip(loads, place(np.array(list(loads.values())), shards), strict=True))
    begin, rows = np.zeros(shards, dtype=np.int64), []
    for u in units:
        s = at[u["whole"]]
        rows.append((u["unit"], int(s), int(begin[s])))
        begin[s] += u["rows"]
    placed = spark.createDataFrame(rows, "unit string, shard int, begin long")
    slot = F.col("begin") + F.row_number().over(Window.partitionBy("unit").orderBy("doc_id")) - 1
    return united.join(F.broadcast(placed), "unit").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE: dict[str, str] = {}
