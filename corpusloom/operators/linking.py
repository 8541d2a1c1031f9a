"""Joins that aren't on ids: similar titles against a catalogue, and title patterns."""

from __future__ import annotations

import difflib
import math
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_RATIO, SALTS = 0.90, 8
#: Characters counted by themselves; all others are counted as one.
CLASSES = string.ascii_lowercase + string.digits + " "


def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: str, b: str) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def _thin(titles: DataFrame, least: float) -> DataFrame:
    """``title`` with its length, its band of lengths and the counts of its characters by class."""
    size = F.length("title")
    counts = [size - F.length(F.replace("title", F.lit(c))) for c in CLASSES]
    kept = titles.withColumn("size", size).withColumn("bag", F.array(*counts))
    # similar titles differ in length by the factor at most, so their bands are the same or neighbours
    factor = (2 - least) / least * (1 + 1e-9)
    return kept.withColumn("band", F.floor(F.log("size") / math.log(factor)))


def catalogue_abstracts(papers: DataFrame, catalogue: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """Of all similar catalogue titles with an abstract the most similar: id, match_id, ratio; of equal ratios the least match_id.

    ``papers`` has id, title; ``catalogue`` has match_id, title, abstract. Equal titles are joined; each other title
    is compared with every one that two upper bounds of the ratio leave: by the lengths, and by the characters in
    common. Both are proven, so no match is lost. Null and blank titles match nothing.
    """
    mine = papers.select("id", F.lower("title").alias("title")).where(F.trim("title") != "")
    theirs = catalogue.where(F.trim("abstract") != "").groupBy(F.lower("title").alias("title")).agg(F.min("match_id").alias("match_id")).where(F.trim("title") != "")
    equal = theirs.select("title", "match_id", F.lit(1.0).alias("ratio"))
    other = mine.select("title").distinct().join(theirs.select("title"), "title", "left_anti")
    a = _thin(other, least).select(F.col("title").alias("_a"), F.col("size").alias("_m"), F.col("bag").alias("_x"), F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), F.pmod(F.xxhash64("title"), F.lit(SALTS)).alias("_salt"))
    b = _thin(theirs, least).select(F.col("title").alias("_b"), "match_id", F.col("size").alias("_n"), F.col("bag").alias("_y"), "band", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("_salt"))
    both = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    # characters outside of the classes count as one class more
    rest = lambda n, bag: F.col(n) - F.aggregate(bag, F.lit(0), lambda s, x: s + x)
    common = both + F.least(rest("_m", "_x"), rest("_n", "_y"))
    needed = (F.col("_m") + F.col("_n")) * F.lit(least / 2) - 1e-6
    pairs = a.join(b, ["band", "_salt"]).where((F.least("_m", "_n") >= needed) & (common >= needed))
    similar = pairs.withColumn("ratio", ratio("_a", "_b")).where(F.col("ratio") >= least)
    best = similar.groupBy(F.col("_a").alias("title")).agg(F.min(F.struct((-F.col("ratio")).alias("less"), "match_id")).alias("_m"))
    found = equal.unionByName(best.select("title", "_m.match_id", (-F.col("_m.less")).alias("ratio")))
    return mine.join(found, "title").select("id", "match_id", "ratio")


def grams(text: Column) -> Column:
    """The distinct runs of three code points, in time linear in the text."""
    chars = F.split(text, "")
    rest = lambda i: F.slice(chars, i, F.greatest(F.size(chars), F.lit(1)))
    both = lambda x, y: F.concat(x, y)
    return F.array_distinct(F.filter(F.zip_with(F.zip_with(chars, rest(2), both), rest(3), both), lambda g: g.isNotNull()))


#: Patterns that are sent to all tasks; of more, the grams of titles are dealt out to them.
MOST_SENT = 1 << 16


def by_pattern_table(papers: DataFrame, patterns: DataFrame) -> DataFrame:
    """``papers`` with the verdict and place of the pattern of least place that fits the title: of (pattern, verdict, place), ``%`` and ``_`` as wild cards, any case.

    Each pattern is filed under the gram of its literal parts that the fewest titles have; a title is held only against patterns filed
    under its grams. Patterns without a gram are held against each title. Papers that no pattern fits are left out, as are null
    titles and patterns; an empty pattern fits an empty title. Of equal places the least verdict counts. A backslash escapes the next character.
    A pattern of several parts that nearly fits a very long title takes time as LIKE does, by the title's length to the power of its parts at worst.
    """
    rules = patterns.select(F.lower("pattern").alias("_p"), "verdict", "place").where("_p is not null")
    # an escaped character or wild card ends a part
    rules = rules.withColumn("_g", F.array_distinct(F.flatten(F.transform(F.split("_p", r"(?s)\\.|[%_]"), grams))))
    few = rules.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = F.broadcast if few else (lambda df: df)
    titles = papers.select(F.lower("title").alias("_t")).where("_t is not null").distinct()
    keyed = titles.select(F.xxhash64("_t").alias("_h"), "_t")
    spread = keyed.select("_h", *(["_t"] if few else []), F.explode(grams(F.col("_t"))).alias("_key"))
    counts = spread.select("_key").join(sent(rules.select(F.explode("_g").alias("_key")).distinct()), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    filed = rules.select("_p", "verdict", "place", F.explode("_g").alias("_key")).join(counts, "_key", "left").groupBy("_p", "verdict", "place").agg(F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), "_key")).alias("_key"))
    near = spread.join(sent(filed), "_key")
    near = near if few else near.drop("_key").join(keyed, "_h")  # a text of equal hash doesn't fit, or does by itself
    fits = F.expr("_t like _p")
    every = keyed.join(sent(rules.where(F.size("_g") == 0).select("_p", "verdict", "place")), fits)
    hits = near.where(fits).select("_t", "verdict", "place").unionByName(every.select("_t", "verdict", "place"))
    first = hits.groupBy("_t").agg(F.min(F.struct("place", "verdict")).alias("_first"))
    return papers.join(first, F.lower(papers["title"]) == first["_t"]).select(*[papers[c] for c in papers.columns if c not in ("verdict", "place")], first["_first"]["verdict"].alias("verdict"), first["_first"]["place"].alias("place"))


def by_pattern(papers: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Verdicts given by title patterns (``%`` and ``_``, any case): the first pattern that fits."""
    fits = [F.when(F.col("title").ilike(p), F.lit(v)) for p, v in patterns]
    return papers.withColumn("verdict", F.coalesce(*fits, F.lit(None).cast("string"))).where("verdict is not null")
