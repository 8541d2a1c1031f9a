"""Pattern tables, JSON texts and criteria, against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from corpusloom.functions.text import json_list, json_object
from corpusloom.operators import criteria, linking


def fits(title, pattern):
    parts = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.fullmatch(parts, title.lower(), re.DOTALL) is not None


def test_a_pattern_table_is_the_nested_loop(spark, monkeypatch):
    rnd = random.Random(4)
    words = "Über agile team 漢字かな data-base x é _ 100% 😀ab".split()
    titles = [" ".join(rnd.choices(words, k=rnd.randint(0, 6))) for _ in range(150)] + ["", "a", "AGILE", "agile\nteam", "long " * 3000 + "needle"]
    papers = [(str(i), t, i) for i, t in enumerate(titles + titles[:9])] + [("n", None, 0), (None, "agile", 1)]
    patterns = ["%needle", "%agile%team%", "", "%", "a_ile", "x%", "%é%", "_", "%not there%", "%漢字%", "%😀a%", "%data_base%"] + ["%" + "%".join(rnd.choices(words, k=2)) for _ in range(60)]
    rnd.shuffle(patterns)
    rules = [(p, rnd.choice(["YES", "NO"]), i) for i, p in enumerate(patterns)] + [(None, "YES", -1), (patterns[0], "ZZ", 0)]
    want = sorted((repr(i), k, *min((n, v) for p, v, n in rules if p is not None and fits(t, p))) for i, t, k in papers if t is not None and any(p is not None and fits(t, p) for p, _, _ in rules))
    df, table = spark.createDataFrame(papers, "id string, title string, _t int"), spark.createDataFrame(rules, "pattern string, verdict string, place int")
    for most in (linking.MOST_SENT, 3):
        monkeypatch.setattr(linking, "MOST_SENT", most)
        got = sorted((repr(r["id"]), r["_t"], r["place"], r["verdict"]) for r in linking.by_pattern_table(df, table).collect())
        assert got == want
    assert linking.by_pattern_table(df, table.limit(0)).count() == 0 == linking.by_pattern_table(df.limit(0), table).count()


def test_json_texts(spark):
    texts = ["", 'a"b', "a\\b", "\\u000B", "\x0b\x0b\\\x1f\x00\x7f", "é漢😀 ", "/\n\r\t\b\f", "\x01\x1a\x0e\x0f"]
    lists = [texts, [], [None, "x"], *[[t] for t in texts]]
    rows = [(i, x, {f"k{j}{t or ''}": t for j, t in enumerate(x)}) for i, x in enumerate(lists)] + [(len(lists), None, None)]
    made = spark.createDataFrame([(i, x, None if not m else list(m)) for i, x, m in rows], "i int, l array<string>, k array<string>")
    df = made.withColumn("m", F.when(F.col("l").isNotNull(), F.map_from_arrays(F.coalesce("k", F.array().cast("array<string>")), "l")))
    got = {r.i: r for r in df.select("i", json_list(df.l).alias("l"), json_object(df.m).alias("m")).collect()}
    for i, x, m in rows:
        assert got[i].l == (None if x is None else json.dumps(x, ensure_ascii=False))
        assert got[i].m == (None if m is None else json.dumps(m, ensure_ascii=False))


def test_criteria_and_settings(spark):
    base = spark.createDataFrame([("IC1", "IC", "a", "one"), ("EC1", "EC", "b", "two"), ("EC0", "EC", "c", None)], criteria.CRITERIA)
    changes = spark.createDataFrame([(2, "EC1", "B", None), (1, "EC1", "x", "y"), (3, "ZZ", "z", "z"), (4, None, "z", "z"), (5, "IC1", None, "1")], "seq int, code string, title string, description string")
    got = criteria.updated(base, changes)
    assert {tuple(r) for r in got.collect()} == {("IC1", "IC", None, "1"), ("EC1", "EC", "B", None), ("EC0", "EC", "c", None)}
    assert tuple(criteria.protocol_text(got).first()) == ("IC1: 1", "EC0: \nEC1: ", "Inclusion Criteria (IC):\nIC1: 1\n\nExclusion Criteria (EC):\nEC0: \nEC1: ")
    assert tuple(criteria.protocol_text(base.limit(0)).first()) == ("", "", "Inclusion Criteria (IC):\n\n\nExclusion Criteria (EC):\n")
    settings = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    sets = spark.createDataFrame([(-5, "a", "9"), (1, "c", "3"), (2, "c", None), (3, None, "x")], "seq int, key string, value string")
    assert {tuple(r) for r in criteria.upserted(settings, sets).collect()} == {("a", "9"), ("b", "2"), ("c", None)}
