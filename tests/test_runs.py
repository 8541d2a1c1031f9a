"""The store of runs against the fold of the whole log."""

import random

import pytest

from corpusloom.operators import runs, store

KINDS = ["decide", "seed", "audit", "quality", "flag", "unflag", "delete"]


def made_up(rnd, first, n, papers):
    out = []
    for seq in range(first, first + n):
        status, code = rnd.choice([("INCLUDED", "IC1"), ("EXCLUDED", "QC_FAIL"), ("EXCLUDED", "EC2"), ("NEEDS_REVIEW", None)])
        out.append((seq, f"p{rnd.randrange(papers)}", rnd.choice(KINDS), status, [code] if code else [], 0.5, rnd.choice(["YES", "NO", None]), rnd.choice([0.5, 1.0, 2.0, 3.5]), rnd.random() < 0.5))
    return out


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def test_runs_fold_as_the_log_does(spark, tmp_path):
    rnd, path, log = random.Random(5), str(tmp_path), []
    assert runs.state(spark, f"{path}/none").count() == 0
    for batch, (n, papers) in enumerate([(300, 60), (14, 80), (5, 3), (40, 100), (0, 1), (2, 9)]):
        events = made_up(rnd, len(log), n, papers)
        log += events
        df = spark.createDataFrame(events + [(len(log), None, "decide", "INCLUDED", [], 0.5, None, None, False)] * bool(n), store.EVENT).selectExpr("*", "true AS gone", "'x' AS live")
        if n:
            log.append((len(log), None, None, None, [], 0.0, None, None, False))
        runs.add(df, path, batch, buckets=4)
        runs.add(df, path, batch, buckets=4)  # tried again
        whole = store.state(spark.createDataFrame([e for e in log if e[1]], store.EVENT))
        assert rows(runs.state(spark, path)) == rows(whole), batch
        asked = ["p1", "p2", "p77", "p1", "unknown", None]
        want = rows(whole.where(whole.paper_id.isin("p1", "p2", "p77")))
        assert rows(runs.decisions_of(spark, path, asked)) == want
        assert rows(runs.decisions_of(spark, path, spark.createDataFrame([(i,) for i in asked], "paper_id string"))) == want
    kept = runs.runs_of(spark, path)
    assert 1 < len(kept) < 6
    with pytest.raises(ValueError, match="not above"):
        runs.add(spark.createDataFrame([log[3]], store.EVENT), path, 99)
    before = rows(runs.state(spark, path))
    runs.clean(spark, path)
    for r in kept:
        spark.sql(f"DROP TABLE {runs._name(path, r['run'])}")  # as a session does that didn't write them
    assert rows(runs.state(spark, path)) == before


def test_the_oldest_run_is_not_shuffled_and_lookups_open_few_buckets(spark, tmp_path):
    rnd, path = random.Random(6), str(tmp_path)
    runs.add(spark.createDataFrame(made_up(rnd, 0, 3000, 2000), store.EVENT), path, 0, buckets=16)
    runs.add(spark.createDataFrame(made_up(rnd, 3000, 60, 2000), store.EVENT), path, 1)
    assert len(runs.runs_of(spark, path)) == 2
    plan = runs.state(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(paper_id" in plan and plan.count("Bucketed: true") == 1  # the later run's
    few = runs.decisions_of(spark, path, ["p1234"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert few.count("SelectedBucketsCount: 1 out of 16") == 1 and "PushedFilters" in few and "paper_id,p1234" in few
