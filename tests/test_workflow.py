"""Listings, exports, resumed runs, calibration rounds, facts, prompts, the stream and the classifier on small fixtures."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classifier, export, facts, lifecycle, listing, prompts, store
from corpusloom.operators import screening as S
from corpusloom.sources.workbook import read_workbook, write_csv, write_workbook
from corpusloom.streaming import screening as stream

PAPER = "ordinal long, id string, title string, abstract string, source_type string, publication_year int, metadata map<string,string>"
DECISION = "paper_id string, status string, codes array<string>, human_decision string"
FACT = "seq long, paper_id string, source string, q1 double, q2 double, q3 double, q4 double, pdf_url string, full_text string"


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        (1, "1", "A tale", "of the sea", "WL", 2016, {"Library": "ACM"}), (2, "2", "Another Tale", None, "GL", 2020, {"Detected_Source": "web", "Library": "x"}),
        (3, "3", None, "tale", "WL", None, {}), (4, "4", "Empty", "", "GL", 2012, {"Keywords": "a; b"}), (5, "5", "Last\x01 & <one>", "x\ny", "WL", 2018, {"Palavra-Chaves": "k"}),
    ]
    made = [("1", "INCLUDED", ["IC1", "IC2"], "YES"), ("2", "EXCLUDED", ["EC3"], None), ("4", "INCLUDED", [], None), ("5", "NEEDS_REVIEW", [], "NO"), ("9", "INCLUDED", ["IC1"], None)]
    known = [(1, "2", "GL", 1.0, 0.5, None, 1.0, None, "fetched"), (2, "2", "GL", None, None, None, None, "http://x/2.pdf", None), (3, "1", "WL", 0.0, 0.5, 0.5, 0.5, None, None)]
    return spark.createDataFrame(rows, PAPER), spark.createDataFrame(made, DECISION), facts.facts(spark.createDataFrame(known, FACT))


def ids(world, **by):
    rows, counts = listing.list_papers(*world, **by)
    return [r.id for r in rows.collect()], tuple(counts.first())


def test_listing(world):
    assert ids(world) == (["1", "2", "3", "4", "5"], (1, 50, 5, 1))
    assert ids(world, search="TALE")[0] == ["1", "2", "3"]
    assert ids(world, year_from=2016)[0] == ["1", "2", "5"]
    assert ids(world, status="INCLUDED") == (["1", "4"], (1, 50, 2, 1))
    assert ids(world, source_type="GL", page=2, size=1) == (["4"], (2, 1, 2, 2))
    assert ids(world, title_contains="none") == ([], (1, 50, 0, 1))
    first = listing.list_papers(*world)[0].collect()
    assert (first[1].source_library, first[1].crawled_abstract, first[1].quality_score, first[2].codes, first[2].status) == ("web", "fetched", 2.5, [], None)


@pytest.mark.parametrize("bad", [{"page": 0}, {"size": 0}, {"size": 501}, {"status": "YES"}, {"source_type": "X"}, {"year_from": 1899}, {"year_to": 2101}])
def test_listing_checks_its_arguments(world, bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        listing.list_papers(*world, **bad)


def test_facts(world):
    got = {r.paper_id: r for r in world[2].collect()}
    assert (got["2"].gl_q3, got["2"].wl_q1, got["2"].pdf_url, got["2"].full_text) == (0.0, None, "http://x/2.pdf", "fetched")
    assert (got["1"].quality_score, got["1"].wl_quality_score, got["2"].quality_score, got["2"].wl_quality_score) == (None, 1.5, 2.5, None) and facts.with_some(world[2]).count() == 2
    assert {(r.paper_id, r.full_text) for r in facts.included(world[1], world[2]).collect()} == {("1", None), ("4", None), ("9", None)}


def test_export(world, spark, tmp_path):
    sheets = {s: export.sheet(*world, s) for s in ("WL", "GL")}
    assert [tuple(r) for r in sheets["GL"].orderBy("number").collect()] == [
        ("web", "2", 1, "Another Tale", "fetched", "", "", "EC3", "", "", "", "", "NO"), ("Unknown Database", "4", 2, "Empty", "(No web content scraped)", "a; b", "", "", "", "", "", "", "YES"),
    ]
    assert [tuple(r) for r in sheets["WL"].collect()] == [("ACM", "1", 1, "A tale", "of the sea", "", "IC1; IC2", "", "YES", "", "", "", "YES")]
    export.write_zip(sheets, str(tmp_path / "r.zip"), {"WL": "white.csv", "GL": "grey.csv"})
    with zipfile.ZipFile(tmp_path / "r.zip") as z:
        raw = z.read("grey.csv")
        rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"))))
    assert raw[:3] == b"\xef\xbb\xbf" and rows[0] == export.HEADERS["GL"] and [r[2] for r in rows[1:]] == ["1", "2"]


def test_workbooks(world, spark, tmp_path):
    odd = spark.createDataFrame([("7", "a\x01b & <c>", "YES"), (None, "d", "NO")], "id string, Title string, Decision string")
    for name in ("a", "b"):
        write_workbook({"White": odd, "Grey": odd.limit(0)}, str(tmp_path / f"{name}.xlsx"), {"White": ["ID", "Title", "Decision"]}, ("Decision",))
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert 's="2"' in sheet and 's="3"' in sheet and 's="1"' in sheet and "cellXfs" in z.read("xl/styles.xml").decode()
    got = read_workbook(spark, f"{tmp_path}/*.xlsx").orderBy("ordinal").collect()
    assert [r.title for r in got] == ["ab & <c>", "d"] * 2 and len({r.ordinal for r in got}) == 4
    assert [r.id for r in got] == ["7", "WL-2@1", "7", "WL-2@2"]
    write_csv(odd, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_resumed(spark):
    rows = [(i, str(i), t, "", "WL" if i < 8 else "GL", 2020, {}) for i, t in enumerate(["One", "one", "Two", "two!", "Three", "three", "One", "Four", "four"])]
    papers = spark.createDataFrame(rows, PAPER)
    existing = spark.createDataFrame([("0", "INCLUDED"), ("2", "NEEDS_REVIEW"), ("5", "EXCLUDED")], "paper_id string, status string")
    got = {r.id: r.code for r in S.resumed(papers, existing, ["EC4"]).collect()}
    assert got == {"1": "EC6", "2": None, "3": None, "4": None, "6": "EC6", "7": None, "8": "EC6"}
    assert {r.id for r in S.resumed(papers, existing, ["EC4"], target="GL").collect()} == {"8"}
    assert {r.id for r in S.resumed(papers, existing, ["EC4"], sample=existing).collect()} == {"2"}


def test_stream_skips_what_is_decided_and_finds_duplicates_across_batches(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    yes = lambda rest: rest.select(F.col("id").alias("paper_id"), F.lit("INCLUDED").alias("status"), F.array(F.lit("IC1")).alias("codes"), F.lit(0.9).alias("confidence"))

    def arrive(rows):
        spark.createDataFrame(rows, PAPER).coalesce(1).write.mode("append").parquet(source)
        stream.screen_stream(spark.readStream.schema(PAPER).parquet(source), log, str(tmp_path / "cp"), ["EC4"], yes).awaitTermination()
        return {r.paper_id: (r.status, list(r.codes)) for r in store.state(stream.read_log(spark, log)).collect()}

    got = arrive([(5, "a", "Title", "", "WL", 2020, {}), (6, "b", "Old", "", "WL", 2001, {})])
    assert got == {"a": ("INCLUDED", ["IC1"]), "b": ("EXCLUDED", ["EC4"])}
    got = arrive([(1, "c", "title!", "", "WL", 2020, {}), (2, "b", "Old", "", "WL", 2020, {}), (3, "d", "New", "", "WL", 2020, {})])
    assert got == {"a": ("INCLUDED", ["IC1"]), "b": ("EXCLUDED", ["EC4"]), "c": ("EXCLUDED", ["EC6"]), "d": ("INCLUDED", ["IC1"])}
    assert stream.read_log(spark, log).where("paper_id = 'b'").count() == 1
    counts = {r.status: r.n for r in stream.progress(store.state(stream.read_log(spark, log))).collect()}
    assert counts == {"INCLUDED": 2, "EXCLUDED": 2}


def test_calibration_round(spark, tmp_path):
    path = str(tmp_path / "log")
    one = lambda i, kind, **sets: spark.createDataFrame([(i,)], "paper_id string").transform(lambda r: lifecycle._events(r, sets.pop("seq", 1), kind, **sets))
    for i in "abc":
        store.append(spark, one(i, "decide", status=F.lit("INCLUDED"), codes=F.array(F.lit("IC2")), confidence=F.lit(1.0)), path)
    state = lambda: store.state(store.read(spark, path))
    assert not lifecycle.in_calibration(state()).first().calibrating
    store.append(spark, lifecycle.registered(spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string"), 2), path)
    assert lifecycle.in_calibration(state()).first().calibrating
    assert tuple(lifecycle.progress(9, state(), True).first()) == (3, 0, 3, 0.0)
    assert tuple(lifecycle.progress(9, state(), False).first()) == (9, 3, 6, 33.3)
    events, counts = lifecycle.audited(state(), spark.createDataFrame([("a",), ("a",), ("z",)], "paper_id string"), "YES", 5)
    assert tuple(counts.first()) == (2, 1, 1)
    store.append(spark, events, path)
    got = {r.paper_id: r for r in state().collect()}
    assert (got["a"].human_decision, got["a"].codes) == ("YES", ["IC1"]) and "z" not in got
    store.append(spark, lifecycle.seeded_from_audits(state(), 6), path)
    assert {r.paper_id for r in state().where("is_calibration").collect()} == {"a"}
    store.append(spark, lifecycle.cleared(state(), 7), path)
    assert state().where("is_calibration").count() == 0
    store.append(spark, lifecycle.audited(state(), spark.createDataFrame([("a",), ("b",)], "paper_id string"), "RESET", 8)[0], path)
    assert {r.paper_id for r in state().collect()} == {"c"}
    with pytest.raises(ValueError, match="verdict"):
        lifecycle.audited(state(), state(), "MAYBE", 9)


def test_verdicts_from_csv(spark, world, tmp_path):
    (tmp_path / "v.csv").write_text("Library,,#,Revisor 1\nACM, 1\u00a0,1, yes \nACM,3,2,No\nACM,77,3,YES\nACM,4,4,perhaps\nACM,5,5,\n")
    events, counts = lifecycle.seeded(lifecycle.read_verdicts(spark, str(tmp_path / "v.csv")), world[0], 1)
    assert {(r.paper_id, r.human_decision) for r in events.collect()} == {("1", "YES"), ("3", "NO")} and tuple(counts.first()) == (5, 2)
    (tmp_path / "named.csv").write_text("ID,Title,Revisor 1\n1,t,NO\n")
    named = lifecycle.read_verdicts(spark, str(tmp_path / "named.csv"), "ID")
    assert [tuple(r) for r in named.collect()] == [("1", "NO")]
    (tmp_path / "w.csv").write_text("ID,Title\n1,t\n")
    with pytest.raises(ValueError, match="Revisor"):
        lifecycle.read_verdicts(spark, str(tmp_path / "w.csv"))
    with pytest.raises(ValueError, match="Nr"):
        lifecycle.read_verdicts(spark, str(tmp_path / "v.csv"), "Nr")


def test_an_exported_sheet_can_be_read_back(spark, world, tmp_path):
    sheet = export.sheet(*world, "WL")
    export.write_csv(sheet, "WL", str(tmp_path / "folder"))
    export.write_zip({"WL": sheet}, str(tmp_path / "r.zip"), {"WL": "white.csv"})
    with zipfile.ZipFile(tmp_path / "r.zip") as z:
        z.extract("white.csv", tmp_path)
    for path in ("folder", "white.csv"):
        events, counts = lifecycle.seeded(lifecycle.read_verdicts(spark, str(tmp_path / path)), world[0], 1)
        assert [(r.paper_id, r.human_decision) for r in events.collect()] == [("1", "YES")] and counts.first().seeded == 1


def test_flat_results(world):
    got = export.results(world[0], world[1])
    assert got.columns == export.RESULT
    assert {tuple(r) for r in got.collect()} == {("1", "A tale", "", "of the sea", "WL", "INCLUDED", "", "IC1; IC2"), ("2", "Another Tale", "", "", "GL", "EXCLUDED", "", "EC3"), ("4", "Empty", "", "", "GL", "INCLUDED", "", ""), ("5", "Last\x01 & <one>", "", "x\ny", "WL", "NEEDS_REVIEW", "", "")}


def test_scores_move_the_state(spark):
    log = spark.createDataFrame([("1", "EXCLUDED", ["EC3"]), ("2", "INCLUDED", ["IC1"]), ("3", "NEEDS_REVIEW", [])], "paper_id string, status string, codes array<string>")
    made = lifecycle._events(log, 0, "decide", status=F.col("status"), codes=F.col("codes"), confidence=F.lit(1.0))
    scores = [(1, "1", "GL", 1.0, 1.0, 0.0, 0.0, None, None), (1, "2", "WL", 0.5, 0.5, None, None, None, None), (2, "2", "GL", 1.0, 1.0, 1.0, 1.0, None, None), (1, "3", "WL", 0.0, 0.0, 0.0, 0.0, None, None), (1, "8", "GL", 0.0, 0.0, 0.0, 0.0, None, None), (2, "3", "GL", None, None, None, None, "u", None)]
    events = facts.score_events(spark.createDataFrame(scores, FACT))
    assert {(r.paper_id, r.status, tuple(r.codes)) for r in store.state(made.unionByName(events)).collect()} == {("1", "EXCLUDED", ("EC3",)), ("2", "INCLUDED", ()), ("3", "EXCLUDED", ("QC_FAIL",))}


def test_audit_metrics_choose_their_source(spark):
    from corpusloom.operators import review

    state = "paper_id string, status string, human_decision string, is_audited boolean, is_calibration boolean"
    known = facts.facts(spark.createDataFrame([(1, "1", "GL", 1.0, 0.5, 1.0, 0.17, None, None), (1, "2", "WL", 1.0, 1.0, 1.0, 1.0, None, None)], FACT))
    rows = [("1", "INCLUDED", "YES", True, False), ("2", "EXCLUDED", "NO", True, False), ("3", "INCLUDED", "NO", True, False), ("4", "NEEDS_REVIEW", "NO", True, False), ("5", "INCLUDED", "YES", False, True)]
    got = lambda rows: review.audit_metrics(spark.createDataFrame(rows, state), known).first()
    r = got(rows)
    assert (r.total_audited, r.calibration_used, r.tp, r.tn, r.fp, r.fn, r.precision, r.avg_quality, r.n_quality) == (3, False, 1, 1, 1, 0, 0.5, 2.67, 1)
    r = got([*rows, ("6", "EXCLUDED", "YES", True, True)])
    assert (r.total_audited, r.calibration_used, r.fn, r.tp, r.kappa) == (1, True, 1, 0, 0.0)
    r = got([*rows, ("6", "NEEDS_REVIEW", "YES", True, True)])
    assert (r.total_audited, r.calibration_used, r.interpretation, r.n_quality) == (1, True, review.NO_PAIRS, 0)
    r = got([("5", "INCLUDED", "YES", False, True)])
    assert (r.total_audited, r.calibration_used, r.interpretation, r.f1) == (0, False, review.NO_AUDITS, 0.0)


def test_prompts(spark, world):
    criteria = spark.createDataFrame([("IC1", "IC", "good"), ("EC1", "EC", "bad")], "code string, type string, description string")
    none = spark.createDataFrame([], "id string, title string, human_decision string")
    got = {r.id: r.prompt for r in prompts.prompts(world[0], criteria, none).collect()}
    assert got["1"] == "Include if:\nIC1: good\n\nExclude if:\nEC1: bad\n\nTitle: A tale\nAbstract: of the sea"
    assert "web source" in got["2"] and got["3"].endswith("Title: \nAbstract: tale")
    found = spark.createDataFrame([("2", "text"), ("1", "other")], "id string, abstract string")
    assert {r.id: r.abstract for r in prompts.with_provenance(world[0], found).collect()} == {"1": "of the sea", "2": "[Abstract automatically retrieved via Crossref API]\n\ntext", "3": "tale", "4": "", "5": "x\ny"}
    scorer = lambda p: p.where("id <> '3'").select(F.col("id").alias("paper_id"), *[F.lit(0.5).alias(f"q{i}") for i in range(1, 5)])
    scored = facts.facts(prompts.quality_events(world[0], scorer, 1))
    assert {(r.paper_id, r.wl_q1, r.gl_q1, r.quality_score, r.wl_quality_score) for r in scored.collect()} == {("1", 0.5, None, None, 2.0), ("2", None, 0.5, 2.0, None), ("4", None, 0.5, 2.0, None), ("5", 0.5, None, None, 2.0)}


def test_classifier_without_and_with_a_model(spark):
    papers = spark.createDataFrame([(str(i), f"{'cat' if i % 2 else 'dog'} story {i}", "the sea and more") for i in range(40)], "id string, title string, abstract string")
    few = papers.limit(3).withColumn("human_decision", F.lit("YES"))
    none = classifier.score(papers, classifier.train(few))
    assert none.where("auto_excluded or p_no is not null or auto_status is not null").count() == 0
    labelled = papers.withColumn("human_decision", F.when(F.col("id").cast("int") % 2 == 1, "YES").otherwise("NO"))
    out = classifier.score(papers, classifier.train(labelled)).collect()
    assert all((r.auto_codes == ["SVM_FAST"] and r.auto_status == "EXCLUDED" and "P(NO)" in r.rationale) == r.auto_excluded for r in out if r.auto_excluded)
    assert all((r.p_no > 0.5) == (int(r.id) % 2 == 0) for r in out)
