"""The posting index against a full scan."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search_index as X

PAPER = "id string, title string, abstract string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    words = "river stone über ÉTÉ naïve 漢字 data-base it's a".split()
    out = [(str(i), " ".join(rnd.choices(words, k=rnd.randint(0, 5))), " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(400)]
    return out + [("n", None, None), ("t", "only the title", None), ("r", "river", "river"), ("r", "river", "river"), (None, "River bed", ""), ("long", "x", "lorem " * 40_000 + "Needle"), ("😀", "a😀b😀c", "")]


def scanned(rows, term, fields=X.FIELDS):
    at = {"title": 1, "abstract": 2}
    return sorted(str(r[0]) for r in rows if any(term.lower() in (r[at[f]] or "").lower() for f in fields) and (term or True))


TERMS = ["river", "RIVER", "er st", "a", "é", "été", "漢字", "字 river", "nothing like it", "needle", "it's a", "😀b😀", "", "only the title", "riv", "stone stone stone"]


def test_search_is_that_of_a_scan(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, PAPER).select("*", F.lit(1).alias("rid"), F.lit(2).alias("batch")).repartition(4)
    X.add(df, str(tmp_path), 0)
    for term in TERMS:
        assert sorted(str(r.id) for r in X.search(spark, str(tmp_path), term).collect()) == scanned(rows, term), term
    assert sorted(str(r.id) for r in X.search(spark, str(tmp_path), "river", ("abstract",)).collect()) == scanned(rows, "river", ("abstract",))
    with pytest.raises(ValueError, match="fields"):
        X.search(spark, str(tmp_path), "x", ("id",))


def test_batches_add_and_replace(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path)
    for k in range(3):
        X.add(spark.createDataFrame(rows[k::3], PAPER), path, k)
    X.add(spark.createDataFrame(rows[1::3], PAPER), path, 1)
    for most in (X.MOST_SENT, 0):
        monkeypatch.setattr(X, "MOST_SENT", most)
        monkeypatch.setattr(X, "MOST_BOUNDS", min(most, X.MOST_BOUNDS))
        for term in TERMS[:6]:
            assert sorted(str(r.id) for r in X.search(spark, path, term).collect()) == scanned(rows, term), term
    X.add(spark.createDataFrame([("new", "river", "")], PAPER), path, 1)
    assert sorted(str(r.id) for r in X.search(spark, path, "river").collect()) == sorted(scanned(rows[0::3] + rows[2::3], "river") + ["new"])
    X.add(spark.createDataFrame([], PAPER), f"{path}/none", 0)
    assert X.search(spark, f"{path}/none", "river").count() == 0


def test_a_search_reads_few_rows(spark, tmp_path):
    """200 files of 50 papers; a rare term lies in one of them, and only that one's rows are read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 2000, numPartitions=40).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("paper of number "), "id").alias("title"), F.lit("some words").alias("abstract"))
        X.add(df, str(tmp_path), 0)
        found = X.search(spark, str(tmp_path), "number 1357")
        assert [r.id for r in found.collect()] == ["1357"]
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        read = [leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()) if "rows" in leaves.apply(i).toString() and "FileScan" in leaves.apply(i).toString()]
        assert read and max(read) <= 200, read
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
