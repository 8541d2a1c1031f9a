"""The stream's keyed state against resumed runs over all papers, and against a plain model over many batches."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import lifecycle, store
from corpusloom.operators import screening as S
from corpusloom.streaming import keyed
from corpusloom.streaming import screening as stream

PAPER = "ordinal long, id string, title string, abstract string, source_type string, publication_year int, metadata map<string,string>"


def scorer(rest):
    """Titles of words of three letters need review, others are in; the abstract shows that the paper came through whole."""
    status = F.when(F.length("title") == 3, "NEEDS_REVIEW").otherwise("INCLUDED")
    return rest.select(F.col("id").alias("paper_id"), status.alias("status"), F.array("abstract", F.col("metadata")["k"]).alias("codes"), F.lit(0.5).alias("confidence"))


def run(spark, tmp_path, rows, scorer=scorer):
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, PAPER).coalesce(1).write.mode("append").parquet(source)
    query = stream.screen_stream(spark.readStream.schema(PAPER).parquet(source), str(tmp_path / "log"), str(tmp_path / "cp"), ["EC4"], scorer)
    query.awaitTermination()
    return query


def test_equals_a_resumed_run(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"p{i}", rnd.choice(["Aa", "aa!", "b", None, "", f"own {i}"]), "", "WL", rnd.choice([2001, 2020]), {}) for i in range(120)]
    made = spark.createDataFrame([(f"p{rnd.randrange(140)}", rnd.choice(["INCLUDED", "EXCLUDED", "NEEDS_REVIEW"])) for _ in range(60)], "paper_id string, status string").dropDuplicates(["paper_id"]).persist()
    store.append(spark, lifecycle._events(made, 0, "decide", status=F.col("status")), str(tmp_path / "log" / "log"))
    run(spark, tmp_path, rows, None)
    want = {(r.id, r.code) for r in S.resumed(spark.createDataFrame(rows, PAPER), made, ["EC4"]).collect()}
    got = {(r.paper_id, r.codes[0] if r.codes else None) for r in stream.read_log(spark, str(tmp_path / "log")).where("seq > 0").collect()}
    assert got == want and len(want) > 60


def test_many_batches(spark, tmp_path):
    """Standings, titles, reviews, deletions and failing scores over batches; a restart before each."""
    log = str(tmp_path / "log" / "log")
    codes = lambda batch: {r.paper_id: (r.status, r.codes) for r in stream.read_log(spark, str(tmp_path / "log")).where(F.col("seq") == batch + 1).collect()}
    p = lambda i, pid, title, year=2020, **meta: (i, pid, title, f"text of {pid} \U0001f600\n\"q\"", "WL", year, {"k": "v", **meta})
    whole = lambda pid: [f"text of {pid} \U0001f600\n\"q\"", "v"]
    q = run(spark, tmp_path, [p(2, "a", "Title"), p(1, "b", "title!"), p(3, "c", "One"), p(9, "d", "Old", 2001), p(9, "d", "Old", 2001), p(5, None, "No id")])
    assert q.lastProgress["sources"][0]["numInputRows"] == 6
    assert codes(0) == {"a": ("EXCLUDED", ["EC6"]), "b": ("INCLUDED", whole("b")), "c": ("NEEDS_REVIEW", whole("c")), "d": ("EXCLUDED", ["EC4"])}
    # c needs review: it registers nothing, and is taken up again when it is sent again
    run(spark, tmp_path, [p(0, "e", "ONE"), p(0, "c", "One"), p(0, "b", "Title"), p(7, "f", "old")])
    assert codes(1) == {"e": ("NEEDS_REVIEW", whole("e")), "c": ("NEEDS_REVIEW", whole("c")), "f": ("EXCLUDED", ["EC6"])}
    one = lambda pid, seq, kind, **sets: store.append(spark, lifecycle._events(spark.createDataFrame([(pid,)], "paper_id string"), seq, kind, **sets), log)
    one("a", 100, "delete")
    one("b", 101, "delete")
    one("c", 102, "quality", score=F.lit(0.5))  # failed: done, so its title registers
    one("e", 103, "quality", score=F.lit(3.0))  # says nothing about its standing
    one("nobody", 104, "decide", status=F.lit("INCLUDED"))
    q = run(spark, tmp_path, [p(0, "g", "Title"), p(1, "a", "Title"), p(2, "h", "one"), p(3, "e", "One"), p(4, "nobody", "Early"), p(5, "i", "Early")])
    got = {r.paper_id: (r.status, r.codes) for r in stream.read_log(spark, str(tmp_path / "log")).where("seq BETWEEN 3 AND 99").collect()}
    assert got == {"g": ("INCLUDED", whole("g")), "a": ("EXCLUDED", ["EC6"]), "h": ("EXCLUDED", ["EC6"]), "e": ("NEEDS_REVIEW", whole("e")), "i": ("EXCLUDED", ["EC6"])}
    # what a batch reads is what arrived: papers, the last batch's decisions and the appended events
    assert sum(s["numInputRows"] for s in q.lastProgress["sources"]) <= 6 + 3 + 5
    # nothing arrives: no batch decides anything, and reading its own decisions back makes none
    n = stream.read_log(spark, str(tmp_path / "log")).count()
    for _ in range(2):
        q = run(spark, tmp_path, [])
    assert stream.read_log(spark, str(tmp_path / "log")).count() == n


def test_hot_title_holds_one_row(spark):
    """The steps alone: rows of one title pass through, whatever their order."""

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    step = keyed.Titles()
    step.held = Value()
    rnd = random.Random(1)
    rows = [keyed._STEP("t", "new", 1, f"p{i}", i // 3, None, "x") for i in range(3000)]
    for _ in range(2):
        rnd.shuffle(rows)
        out = list(step.handleInputRows(("t",), iter(rows), None))
        assert len(out) == 3000 and len({r.paper_id for r in out}) == 3000
        assert [r.paper_id for r in out if r.code is None] == (["p0"] if step.held.v == (3000,) else [])
    assert step.held.v == (6000,)
