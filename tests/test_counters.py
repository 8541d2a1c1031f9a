"""Cells kept by changes against a recount, after every batch of a random log."""

import random

import pytest
from test_runs import made_up

from corpusloom.operators import counters, review, runs, store


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def test_cells_follow_the_log(spark, tmp_path, monkeypatch):
    rnd, path, log = random.Random(8), str(tmp_path), []
    assert counters.cells(spark, path).count() == 0
    for batch, (n, papers) in enumerate([(200, 40), (30, 60), (0, 1), (6, 2), (40, 80)]):
        events = made_up(rnd, len(log), n, papers)
        if batch == 3:  # a paper that goes, and one that comes back
            events = [(e[0], f"p{i % 2}", "delete" if i < 4 else "decide", *e[3:]) for i, e in enumerate(events)]
        log += events
        df = spark.createDataFrame(events, store.EVENT)
        if batch == 1:  # lost after the store took the batch in, then after the counts before it were written
            for lost, of in (("add", runs), ("_write", counters)):
                with monkeypatch.context() as m:
                    m.setattr(of, lost, lambda *_: (_ for _ in ()).throw(OSError("lost")))
                    with pytest.raises(OSError, match="lost"):
                        counters.add(df, path, batch, buckets=4)
        for _ in range(2):  # tried again, then sent once more
            counters.add(df, path, batch, buckets=4)
        whole = store.state(spark.createDataFrame(log, store.EVENT))
        got = counters.cells(spark, path)
        assert rows(got) == rows(counters.cells_of(whole)), batch
    assert counters.confusion(got).first() == review.confusion(review.pairs_of(whole)).first()
    total = whole.where("is_calibration").count()
    pending = whole.where("is_calibration AND status = 'NEEDS_REVIEW'").count()
    assert tuple(counters.sample_progress(got).first()) == (total, total - pending, pending)
    shown = counters.progress(got, ["EC2"]).first()
    assert (shown.screened, shown.by_rule) == (whole.count(), whole.where("array_contains(codes, 'EC2')").count())


def test_no_papers_and_other_batches(spark, tmp_path):
    path, none = str(tmp_path), spark.createDataFrame([], store.EVENT)
    one = lambda seq, pid, kind: spark.createDataFrame([(seq, pid, kind, "INCLUDED", ["IC1"], 1.0, None, None, False)], store.EVENT).selectExpr("*", "1 AS n", "'x' AS is_audited")
    counters.add(none, path, 0, buckets=2)
    assert counters.cells(spark, path).count() == 0
    assert tuple(counters.progress(counters.cells(spark, path), []).first()) == (0, 0, 0, 0, 0)
    counters.add(one(1, "a", "decide"), path, 1)
    assert [r.n for r in counters.cells(spark, path).collect()] == [1]
    counters.add(one(2, "a", "delete"), path, 2)
    assert counters.cells(spark, path).count() == 0
    counters.add(one(3, None, "decide"), path, 3)
    runs.add(one(4, "b", "decide"), path, 4)
    with pytest.raises(ValueError, match="recount"):
        counters.add(one(5, "c", "decide"), path, 5)
    counters.recounted(spark, path)
    counters.add(one(5, "c", "decide"), path, 5)
    assert [r.n for r in counters.cells(spark, path).collect()] == [2]
