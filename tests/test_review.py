import datetime as dt
import difflib
import random

from pyspark.sql import functions as F

from corpusloom.functions.response import parse_answer, parse_quality
from corpusloom.operators import classifier, linking, sampling, store
from corpusloom.operators import review as R
from corpusloom.plans import QUERIES
from corpusloom.streaming import screening as live


def test_answers(spark):
    cases = {
        '{"decision":"INCLUDED","criteria_evaluation":{"IC2":true,"IC1":true}}': ("INCLUDED", 1.0, ["IC2", "IC1"]),
        '{"decision":"INCLUDED","criteria_evaluation":{"IC1":true,"EC3":true,"EC2":true}}': ("EXCLUDED", 1.0, ["EC2", "EC3"]),
        '{"decision":"EXCLUDED","criteria_evaluation":{"IC2":true}}': ("NEEDS_REVIEW", 0.5, ["IC2"]),
        '{"decision":"INCLUDED","criteria_evaluation":{"IC1":"true"}}': ("INCLUDED", 1.0, []),
        '{"status":"INCLUDED","applied_criteria_codes":["IC1"],"criteria_evaluation":null}': ("INCLUDED", 1.0, ["IC1"]),
        "[]": ("NEEDS_REVIEW", 0.0, []),
        "null": ("NEEDS_REVIEW", 0.0, []),
        "{": ("NEEDS_REVIEW", 0.0, []),
    }
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string").withColumn("a", parse_answer(F.col("c")))
    for r in df.collect():
        assert tuple(r.a) == (cases[r.c] if r.c else ("NEEDS_REVIEW", 0.0, [])), r.c


def test_quality(spark):
    df = spark.createDataFrame([('{"q1":1,"q2":0.5}',), ("x",)], "c string").select(parse_quality(F.col("c")).alias("q"))
    assert [r.q.score for r in df.collect()] == [1.5, 0.0]


def events(spark, *rows):
    full = [(i, "p", k, s.get("status"), s.get("codes"), 1.0, s.get("human"), s.get("score"), s.get("reconcile", False)) for i, (k, s) in enumerate(rows)]
    return spark.createDataFrame(full, store.EVENT)


def test_store(spark):
    decide = ("decide", {"status": "INCLUDED", "codes": ["IC1"]})
    one = store.state(events(spark, ("audit", {"human": "YES"}), decide, ("quality", {"score": 1.0}))).first()
    assert (one.status, one.codes, one.human_decision) == ("EXCLUDED", ["QC_FAIL"], None)
    one = store.state(events(spark, decide, ("quality", {"score": 1.0}), ("quality", {"score": 3.0}))).first()
    assert (one.status, one.codes, one.score) == ("INCLUDED", [], 3.0)
    one = store.state(events(spark, decide, ("audit", {"human": "NO", "reconcile": True}), ("flag", {}))).first()
    assert (one.status, one.codes, one.human_decision, one.is_calibration) == ("INCLUDED", ["EC5"], "NO", True)
    assert store.state(events(spark, decide, ("delete", {}))).count() == 0
    one = store.state(events(spark, decide, ("delete", {}), ("seed", {"human": "YES"}))).first()
    assert (one.status, one.codes, one.human_decision, one.is_calibration) == ("NEEDS_REVIEW", [], "YES", True)


def test_samples(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("paper_id"), F.when(F.col("id") < 990, "EXCLUDED").otherwise("INCLUDED").alias("status"))
    got = sampling.audit_sample(df, 50).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} in ({"EXCLUDED": 49, "INCLUDED": 1}, {"EXCLUDED": 50})
    first = {r.paper_id for r in sampling.audit_sample(df, 50).collect()}
    assert first == {r.paper_id for r in sampling.audit_sample(df.repartition(7), 50).collect()}


def test_classifier(spark):
    rows = [(f"a{i}", "neural tests of code" if i % 2 else "poster on cats", "", "YES" if i % 2 else "NO") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, title string, abstract string, human_decision string")
    assert classifier.train(df.limit(3)) is None
    got = {r.id: r for r in classifier.score(df, classifier.train(df)).collect()}
    assert got["a0"].p_no > 0.9 and got["a0"].auto_excluded and got["a1"].p_no < 0.1


def test_linking(spark):
    papers = spark.createDataFrame([("1", "A study of agile teams"), ("2", "Nothing alike")], "id string, title string")
    catalogue = spark.createDataFrame([("c1", "A Study of Agile Team", "text"), ("c2", "A study of agile teams", " "), ("c3", "Agile", "x")], "match_id string, title string, abstract string")
    assert [(r.id, r.match_id) for r in linking.catalogue_abstracts(papers, catalogue).collect()] == [("1", "c1")]
    assert [(r.id, r.verdict) for r in linking.by_pattern(papers, [("%AGILE%", "YES")]).collect()] == [("1", "YES")]


def test_stream_goes_on(spark, tmp_path):
    schema = "id string, title string, publication_year int, metadata map<string,string>"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live.screen_stream(spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "cp"), ["EC1", "EC3", "EC4"]).awaitTermination()

    run([("1", "A poster", 2020, {}), ("2", "x", 2020, {})])
    run([("2", "x", 2010, {})])
    got = {r.paper_id: (r.status, r.codes) for r in store.state(live.read_log(spark, log)).collect()}
    assert got == {"1": ("EXCLUDED", ["EC3"]), "2": ("EXCLUDED", ["EC4"])}


def test_windows(spark):
    t = dt.datetime(2024, 1, 1, 5)
    got = live.windowed_counts(spark.createDataFrame([(t, "a"), (t, "a"), (t + dt.timedelta(days=1), "a")], "ts timestamp, event_type string")).collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_places_cover_all_rows(spark):
    ids = [str(i * i % 997) for i in range(400)] + [f"paper-{i:05d}" for i in range(400)] + ["-3", "x", "", None, "99999999999999999999"]
    key = lambda v: (1, "") if v is None else (2, v)
    number = lambda v: v is not None and v.lstrip("-").isdigit() and len(v) < 19
    want = sorted(ids, key=lambda v: (not number(v), int(v) if number(v) else 0, key(v)))
    n = F.col("id").try_cast("bigint")
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    got = R.places(df, n.isNull(), n, F.col("id")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, len(ids) + 1))
    assert R.places(df.limit(0), n.isNull(), n, F.col("id")).count() == 0


def test_qa_order_all_is_whole(spark):
    d = "/root/testdata/sf0.001"
    whole = {r.id: r.place for r in QUERIES["qa_order_all"](spark, d).collect()}
    assert len(whole) == spark.read.parquet(f"{d}/documents.parquet").count() > 100


def test_quality_is_over_all_scores(spark):
    rows = [("INCLUDED", "YES", 1.0), ("EXCLUDED", None, 3.0), ("NEEDS_REVIEW", "NO", 4.0), ("EXCLUDED", "NO", None)]
    df = spark.createDataFrame(rows, "status string, human_decision string, score double")
    assert tuple(R.quality_stats(df).first()) == (2, 2.67, 3)
    assert tuple(R.quality_stats(df.limit(0)).first()) == (0, 0.0, 0)
    d = "/root/testdata/sf0.001"
    assert QUERIES["audit_quality_all"](spark, d).first().n_quality == spark.read.parquet(f"{d}/labels.parquet").count() > 0


def test_linking_loses_no_match(spark):
    draw = random.Random(3)
    words = "agile teams study of code review in large systems the näive σ".split()
    titles = [" ".join(draw.choices(words, k=draw.randint(1, 9))) for _ in range(40)]
    near = [t[: draw.randint(0, len(t))] + draw.choice("xé ") + t[draw.randint(0, len(t)) :] if i % 3 else t[:-1] + "q" for i, t in enumerate(titles)]
    # eight templates of the same rare words come before the equal title, and blank abstracts before all
    same = [(f"a{i}", f"quantum zebra yonder xylophone passage number {'abcdefgh'[i] * 30}", "text") for i in range(8)]
    whole = "quantum zebra yonder xylophone passage number nine"
    catalogue = same + [(f"b{i}", whole, " " if i % 2 else None) for i in range(5)] + [("z", whole.upper(), "text"), ("zz", whole, "text")]
    catalogue += [(f"c{i}", t, "text" if i % 4 else "") for i, t in enumerate(near)] + [("e", "", "text"), ("f", None, "text")]
    papers = [("p", whole), ("q", whole[:-1]), ("e", ""), ("f", None)] + [(f"t{i}", t) for i, t in enumerate(titles)]
    want = {}
    for i, t in papers:
        fits = [(-difflib.SequenceMatcher(None, t.lower(), c.lower()).ratio(), m) for m, c, x in catalogue if t and c and (x or "").strip()]
        if fits and min(fits)[0] <= -0.9:
            want[i] = (min(fits)[1], -min(fits)[0])
    got = linking.catalogue_abstracts(spark.createDataFrame(papers, "id string, title string"), spark.createDataFrame(catalogue, "match_id string, title string, abstract string")).collect()
    assert {r.id: (r.match_id, r.ratio) for r in got} == want and len(got) == len(want)
    assert want["p"] == ("z", 1.0) and want["q"][0] == "z" and 5 < len(want) < len(papers)
