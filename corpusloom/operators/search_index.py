"""A trigram posting index over titles and abstracts, for substring search without a scan of all texts.

The index has two tables, each in a folder a batch, so papers are added by writing a further folder and a batch that is
written again replaces itself. ``rows`` holds the lower-cased texts under ascending row numbers; ``postings`` holds for each
gram of three code points, field and block of rows the rows that have it, as offsets from the block's first. A task makes
the postings of the rows that it reads, in blocks of bounded size, so nothing is shuffled, and sorts them by gram, so a lookup
passes over row groups without its grams.

A search takes its term's grams, rarest first by their counts, intersects within blocks the rows of the rarest few,
fetches those rows alone and holds the term against their texts. So results are those of a full scan.

Cases: case is folded as ``lower`` does. A term of fewer than three code points has no gram, and all texts are scanned. An empty term
matches every paper. A null or empty text matches no other term. Repeated rows are found each. An empty table gives an index without rows.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "rid long, id string, title string, abstract string"
POSTINGS = "gram long, field string, first long, n int, offsets array<int>"
FIELDS = ("title", "abstract")
#: Rows and (gram, row) pairs of a block; bytes of text whose grams are made at once; bytes of a file's row group.
BLOCK_ROWS, BLOCK_PAIRS, ROOM, GROUP_BYTES = 1 << 16, 1 << 20, 1 << 18, 8 << 20
#: Grams of a term that are intersected, candidate rows that are sent to all tasks, and blocks whose bounds go to the scan.
RAREST, MOST_SENT, MOST_BOUNDS = 3, 1 << 18, 64


def grams_of(text: str) -> list[int]:
    """The distinct grams of a text, as numbers of 63 bits: a code point has 21."""
    c = list(map(ord, text))
    return sorted({x << 42 | y << 21 | z for x, y, z in zip(c, c[1:], c[2:], strict=False)})


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text's number) without repeats."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    whole = of[2:] == of[:-2]
    gram, of = (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[whole], of[2:][whole]
    distinct, number = np.unique(gram, return_inverse=True)
    pairs = np.unique(number * len(texts) + of)
    return distinct[pairs // len(texts)], pairs % len(texts)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {f: [] for f in FIELDS}
    first, last, pairs = 0, -1, 0

    def given() -> Iterator[pa.RecordBatch]:
        for field, parts in held.items():
            if parts:
                gram, row = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(gram, kind="stable")  # rows ascend as they came
                gram, row = gram[order], row[order]
                begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
                ends = np.append(begin, len(gram)).astype(np.int32)
                n = len(begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[begin]), pa.array([field] * n, pa.string()), pa.array(np.full(n, first)), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(row.astype(np.int32)))],
                    names=[c.split()[0] for c in POSTINGS.split(", ")],
                )
            parts.clear()

    for b in batches:
        rids, texts = b.column("rid").to_numpy(), {f: [t or "" for t in b.column(f).to_pylist()] for f in FIELDS}
        at = 0
        while at < len(rids):
            to, size = at, 0
            # rows side by side: numbers without a gap, and not too much text
            while to < len(rids) and (to == at or (rids[to] == rids[to - 1] + 1 and size < ROOM)):
                size += sum(len(texts[f][to]) for f in FIELDS)
                to += 1
            if last >= 0 and (rids[at] != last + 1 or rids[at] - first >= BLOCK_ROWS or pairs >= BLOCK_PAIRS):
                yield from given()
                last, pairs = -1, 0
            if last < 0:
                first = int(rids[at])
            for f in FIELDS:
                gram, of = _pairs(texts[f][at:to])
                held[f].append((gram, of + int(rids[at]) - first))
                pairs += len(gram)
            last, at = int(rids[to - 1]), to
    if last >= 0:
        yield from given()


def add(papers: DataFrame, path: str, batch: int) -> None:
    """Write the papers (id, title, abstract) as a batch of the index; a batch that is there already is replaced."""
    spark = papers.sparkSession
    lower = [F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS]
    rows = papers.select(F.monotonically_increasing_id().alias("rid"), F.col("id").cast("string").alias("id"), *lower)
    rows.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/rows/batch={batch}")
    again = spark.read.schema(ROWS).parquet(f"{path}/rows/batch={batch}").select("rid", *FIELDS)
    posted = again.mapInArrow(_posted, POSTINGS).sortWithinPartitions("gram", "field")
    posted.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings/batch={batch}")


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{kind}")


def _candidates(spark: SparkSession, path: str, needle: str, fields: tuple[str, ...]) -> DataFrame | None:
    """batch, first, rid of the rows that hold the rarest grams of the term in a field; None if no row can."""
    grams = grams_of(needle)
    posted = _read(spark, path, "postings", POSTINGS).where(F.col("gram").isin(grams) & F.col("field").isin(*fields))
    counts = {(r["field"], r["gram"]): r["n"] for r in posted.groupBy("field", "gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the term and field
    out = []
    for field in fields:
        if any((field, g) not in counts for g in grams):
            continue
        rarest = sorted(grams, key=lambda g: (counts[field, g], g))[:RAREST]
        some = posted.where((F.col("field") == field) & F.col("gram").isin(rarest))
        # of one block: RAREST lists of a block's rows at most
        met = some.groupBy("batch", "first").agg(F.collect_list("offsets").alias("lists")).where(F.size("lists") == len(rarest))
        both = F.aggregate("lists", F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        out.append(met.select("batch", "first", F.explode(F.transform(both, lambda o: F.col("first") + o)).alias("rid")))
    return functools.reduce(DataFrame.unionAll, out).distinct() if out else None


def search(spark: SparkSession, path: str, term: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """ids of the papers that have the term in one of the fields, whatever its case."""
    if not set(fields) <= set(FIELDS) or not fields:
        raise ValueError(f"fields are of {FIELDS}")
    needle = term.lower()
    rows = _read(spark, path, "rows", ROWS)
    if not needle:
        return rows.select("id")
    fits: Column = functools.reduce(Column.__or__, [F.col(f).contains(needle) for f in fields])
    if len(needle) < 3:
        return rows.where(fits).select("id")
    found = _candidates(spark, path, needle, fields)
    if found is None:
        return rows.where("false").select("id")
    found = found.cache()
    bounds = found.groupBy("batch", "first").agg(F.min("rid").alias("least"), F.max("rid").alias("most")).limit(MOST_BOUNDS + 1).collect()
    if len(bounds) <= MOST_BOUNDS:  # so the scan passes over row groups without candidates
        ranges = [(F.col("batch") == r["batch"]) & F.col("rid").between(r["least"], r["most"]) for r in bounds]
        rows = rows.where(functools.reduce(Column.__or__, ranges)) if ranges else rows.where("false")
    keys = found.select("batch", "rid")
    if keys.count() <= MOST_SENT:
        keys = F.broadcast(keys)
    return rows.join(keys, ["batch", "rid"]).where(fits).select("id")
