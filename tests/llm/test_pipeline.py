"""Each stage and the whole of the corpus pipeline against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from corpusloom.llm import language_id, packing, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    lexicon = {"en": "the house river and green walks over stone with old".split(), "de": "das haus und fluss der alte stein mit gruen ueber".split()}
    out = []
    for i in range(600):
        lang = "en" if i % 2 else "de"
        out.append((i, " ".join(rnd.choice(lexicon[lang]) + rnd.choice(["", "en", "er"]) for _ in range(rnd.randint(8, 60))), lang))
    out += [(1200, out[5][1], "en"), (5, out[5][1], "en"), (5, out[5][1], "en"), (None, out[7][1], "en"), (None, "the old green house by itself walks", "en"), (None, "the old green house by itself walks", "en")]
    out += [(1201, out[9][1] + ' token = "abcdefgh12345"', "en"), (1202, None, "en"), (1203, "", None), (1204, "12 34 ½", None), (1205, "xqzv kjwp qqxz vvkj zxcq wjkq " * 30, None), (1206, "the river", "en")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in out]


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def one_of_each(rows):
    s, label = [sets(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    best = {}
    for k, r in enumerate(rows):
        best[label[k]] = min(best.get(label[k], (True, 0, k)), (r[0] is None, r[0] or 0, k))
    return [rows[k] for _, _, k in best.values()]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    told = P.language_id(spark, docs, "").collect()
    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    want = [r for r, (lang, _, typical) in zip(rows, model.predict([r[1] or "" for r in rows]), strict=True) if lang != "und" and typical >= 0.5]
    assert Counter(map(tuple, told)) == Counter(want)
    gone = Counter(r[0] for r in rows) - Counter(r[0] for r in told)
    assert set(gone) == {1202, 1203, 1204, 1205}

    single = P.near_duplicate_join(spark, spark.createDataFrame(told, SCHEMA), "").collect()
    assert Counter((r.doc_id, r.text) for r in single) == Counter((r[0], r[1]) for r in one_of_each([tuple(r) for r in told]))
    assert Counter(r.doc_id for r in single)[5] == 1 and Counter(r.doc_id for r in single)[None] == 1

    clean = P.secret_scan(spark, spark.createDataFrame(single, SCHEMA), "").collect()
    for before, after in zip(sorted(single, key=str), sorted(clean, key=str), strict=True):
        base = secret_scan.base_spans(before.text)
        assert after.text == (before.text if not base else before.text[: base[0][0]] + "[ASSIGN]" + before.text[base[0][1] :])
        assert after.n_chars == len(after.text)

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.public_tokenizer())
    packed = P.packing(spark, spark.createDataFrame(clean, SCHEMA), "").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in packed) == Counter((r.doc_id, (*own.encode(r.text, add_special_tokens=False).ids, 1)) for r in clean)


def test_run(spark, rows, tmp_path):
    rows = rows[500:]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    told = [r for r, (lang, _, typical) in zip(rows, model.predict([r[1] or "" for r in rows]), strict=True) if lang != "und" and typical >= 0.5]
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in one_of_each(told))
    assert all(r.ids[-1] == 1 and len(r.ids) == r.length for r in got)


def test_an_empty_table_passes_all_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).where("false")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == P.COLUMNS
    assert docs.count() == 0
