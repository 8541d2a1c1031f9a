"""Vector codes, language-model scores and whitening, held against brute force on whole tables and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_scores, vector_codes, whitening

DIR = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<double>, label int"
CLASH = ["code", "error", "label_error", "entry", "at", "value", "component", "deviation", "whitened", "explained", "_label", "_l"]


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def odd():
    """Rows of (id, vector, label): nulls in any column, bad components, other lengths, repeated rows and ids, ties."""
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=8)], int(rnd.integers(0, 3))) for i in range(60)]
    rows += [(5, rows[5][1], 1), (5, rows[7][1], None), (None, rows[9][1], None), (70, rows[2][1], 2), (70, rows[2][1], 2)]
    rows += [(80, None, 1), (81, [1.0] * 7 + [None], 1), (82, [1.0] * 7 + [float("nan")], 1), (83, [float("-inf")] + [0.0] * 7, 1), (84, [1.0] * 4, 1), (85, [], 1)]
    rows += [(90 + i, [0.5] * 8, 4) for i in range(5)]
    return rows


def usable(rows, dims=8):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_codes(rows, parts, entries, rounds):
    width = len(rows[0][1]) // parts
    x = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[x[i][p * width : (p + 1) * width] for i in order] for p in range(parts)]

    def assign():
        out = []
        for v in x:
            out.append([min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(order)):
                own = [v[p * width : (p + 1) * width] for v, g in zip(x, got, strict=True) if g[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [("".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g)) for g in assign()], ",".join(str(c) for b in books for e in b for c in e)


@pytest.mark.parametrize("entries", [4, 64, 200])
def test_codes_of_odd_rows(spark, odd, entries):
    df = with_clashes(spark.createDataFrame(odd, VEC)).repartition(3)
    books = vector_codes.fitted(df, "vec_id", "embedding", parts=4, entries=entries)
    kept = usable(odd)
    want, digits = brute_codes(kept, 4, entries, 2)
    assert books.digest() == hashlib.sha256(digits.encode()).hexdigest()
    codes = vector_codes.encoded(df, "embedding", books)
    assert set(codes.columns) == {"vec_id", "label", *CLASH}
    plain = codes.select("vec_id", "label", "code", "error")
    got = vector_codes.with_label_error(plain, "label").collect()
    sums = Counter()
    for (_, _, label), (_, e) in zip(kept, want, strict=True):
        sums[label] += e
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter((i, c, e, sums[label]) for (i, _, label), (c, e) in zip(kept, want, strict=True))


def test_codes_of_few_and_no_rows(spark, monkeypatch):
    assert vector_codes.fitted(spark.createDataFrame([], VEC), "vec_id", "embedding") is None
    assert vector_codes.fitted(spark.createDataFrame([(1, None, 1)], VEC), "vec_id", "embedding") is None
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fitted(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], VEC), "vec_id", "embedding", parts=2)
    one = spark.createDataFrame([(None, [1.0, -2.001], None)], VEC)
    books = vector_codes.fitted(one, "vec_id", "embedding", parts=2)
    assert books.books.tolist() == [[[256]], [[-513]]]
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)  # the join by shuffle
    assert [tuple(r) for r in vector_codes.with_label_error(vector_codes.encoded(one, "embedding", books), "label").select("code", "error", "label_error").collect()] == [("0000", 0, 0)]


def test_codes_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{DIR}/embeddings.parquet')")
    want = con.execute(vector_codes.ORACLE["op11_vector_codes"]).fetchall()
    got = vector_codes.op11_vector_codes(spark, DIR)
    assert got.columns == [c[0] for c in con.description]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_nearest_is_exact():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        x, book = rnd.integers(-3, 4, (40, 3)), rnd.integers(-3, 4, (rnd.integers(1, 20), 3))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, least = vector_codes.nearest(x, book, vector_codes.Codebooks(book[None]).order[0])
        assert (entry == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def brute_whitening(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(v.tolist(), s.tolist(), strict=True)) for v in x]
    y = (n * x - s) / n
    v = y.T @ y / n
    return y, v, deviation


def test_whitening_of_odd_rows(spark, odd):
    df = with_clashes(spark.createDataFrame(odd, VEC)).repartition(3)
    kept = usable(odd)
    y, v, deviation = brute_whitening(kept)
    model = whitening.fitted(df, "embedding")
    assert model.n == len(kept)
    assert np.allclose(model.vectors.T @ v @ model.vectors, np.diag(model.values), atol=1e-9 * model.trace)
    out = whitening.whitened(df, "embedding", model)
    assert set(out.columns) == {"vec_id", "label", *CLASH}
    got = out.select("vec_id", "component", "deviation", "whitened", "explained").collect()
    want = Counter((i, k + 1, d) for (i, _, _), d in zip(kept, deviation, strict=True) for k in range(8))
    assert Counter((r.vec_id, r.component, int(r.deviation)) for r in got) == want
    values = np.linalg.eigvalsh(v)[::-1]
    for r in got:
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-10
    first = next(j for j, r in enumerate(kept) if r[0] == 0)
    w = np.array([r.whitened for r in sorted((r for r in got if r.vec_id == 0), key=lambda r: r.component)])
    assert np.allclose(w, y[first] @ model.vectors / np.sqrt(values), rtol=1e-8, atol=1e-10)
    assert whitening.identity_error(df, "embedding", model) < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.fitted(spark.createDataFrame([], VEC), "embedding") is None
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], VEC)
    model = whitening.fitted(same, "embedding")
    assert whitening.identity_error(same, "embedding", model) == 0
    assert {tuple(r) for r in whitening.whitened(same, "embedding", model).select("component", "deviation", "whitened", "explained").collect()} == {(1, 0, None, None), (2, 0, None, None)}
    flat = spark.createDataFrame([(i, [float(i), float(i), 3.0], 0) for i in range(9)], VEC)
    model = whitening.fitted(flat, "embedding")
    assert model.varies.tolist() == [True, False, False] and whitening.identity_error(flat, "embedding", model) < 1e-12


def test_small_eigenvalues_are_accurate():
    rnd = np.random.default_rng(9)
    q, _ = np.linalg.qr(rnd.normal(size=(12, 12)))
    scale = 10.0 ** np.arange(0, -12, -1)
    base = rnd.normal(size=(12, 12)) * 0.1 + np.eye(12)
    graded = scale[:, None] * (base @ base.T) * scale[None, :]  # graded, as of dimensions of unlike scale
    values, vectors = whitening.jacobi(graded)
    from fractions import Fraction

    exact = np.prod(values)  # the determinant is known well: of the graded matrix it is the product of the scales' squares and of base's
    assert abs(exact / (np.linalg.det(base) ** 2 * float(np.prod([Fraction(s) ** 2 for s in scale]))) - 1) < 1e-8
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-12)
    assert np.allclose(q @ q.T, np.eye(12))


def test_exact_sums_beyond_doubles(spark):
    rows = [(i, [float(2**40 + i), float(-(2**40) - 3 * i * i)], 0) for i in range(50)]
    df = spark.createDataFrame(rows, VEC)
    model = whitening.fitted(df, "embedding")
    _, v, _ = brute_whitening(rows)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {(i, sum((50 * a - b) ** 2 for a, b in zip(r, s, strict=True))) for i, r in enumerate(x)}
    assert {(r.vec_id, int(r.deviation)) for r in whitening.whitened(df, "embedding", model).collect()} == want
    assert whitening.identity_error(df, "embedding", model) < 1e-6


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute_scores(rows, order, strength):
    count, learned = Counter(), [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    for t in learned:
        s = [1, *words_of(t), 2]
        count.update(tuple(s[j : j + k]) for k in range(1, order + 1) for j in range(len(s) - k + 1))
    tokens = {k: v for k, v in count.items() if len(k) == 1 and k != (1,)}
    n, v = sum(tokens.values()), len(tokens)

    def p(h, w):
        return (count[*h, w] + strength * p(h[1:], w)) / (count[h] + strength) if h else (count[w,] + 1) / (n + v + 1)

    out = []
    for i, t in rows:
        s = [1, *words_of(t), 2]
        known = sum(count[w,] > 0 for w in s[1:])
        base = sum(math.log10((count[w,] + 1) / (n + v + 1)) for w in s[1:])
        score = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(s) - 1, known, n, base, score))
    return out


def alike(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9), (g, w)


@pytest.mark.parametrize(("order", "slice_tokens", "bucket_tokens", "segment"), [(1, 50, 100, 4), (2, 50, 100, 4), (3, 300, 40, 5), (3, 1 << 21, 1 << 20, 64), (5, 200, 1000, 3)])
def test_scores_of_odd_rows(spark, order, slice_tokens, bucket_tokens, segment):
    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice(list("abcdefgh"), rnd.integers(0, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1, texts[1]), (1, texts[2]), (None, texts[3]), (None, None), (100, None), (101, ""), (102, " \n\t"), (103, "A B c\x0bD"), (104, "a b é É"), (105, " ".join(["a b c"] * 5000)), (106, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("slice"), F.lit(2).alias("held"), F.lit(3).alias("score"))
    sizes = ngram_scores.Sizes(slice_tokens, bucket_tokens, segment)
    alike(ngram_scores.scores(df.repartition(3), order=order, strength=2.5, sizes=sizes).collect(), brute_scores(rows, order, 2.5))


def test_scores_without_training(spark):
    schema = "doc_id long, text string"
    assert ngram_scores.scores(spark.createDataFrame([], schema)).count() == 0
    got = ngram_scores.scores(spark.createDataFrame([(1, "a b"), (2, None)], schema), learn=F.lit(False)).collect()
    assert {tuple(r) for r in got} == {(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)}


def test_probabilities_add_up(spark):
    """Texts of one word, over all known words and an unknown one: with the end mark after them they are all texts of one token's choice."""
    rows = [(i, " ".join("abcde"[(i * j) % 5] for j in range(6))) for i in range(30)]
    learned = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(True).alias("own"))
    probes = spark.createDataFrame([(1000 + i, w) for i, w in enumerate([*"abcde", "unknown", ""])], "doc_id long, text string").select("*", F.lit(False).alias("own"))
    got = {r.doc_id: r.score for r in ngram_scores.scores(learned.unionByName(probes), learn=F.col("own"), order=2).collect() if r.doc_id >= 1000}
    # p(w | begin) = p(text w) / p(end | w); p(end | w) is the same sum's share, so it is taken from texts that repeat w
    count = Counter()
    for _, t in rows:
        s = ["<", *t.split(), ">"]
        count.update(s)
        count.update(zip(s, s[1:], strict=False))
    n, v = sum(count[w] for w in "abcde") + count[">"], sum(count[w] > 0 for w in "abcde") + 1
    m = ngram_scores.STRENGTH
    end = lambda w: (count[w, ">"] + m * (count[">"] + 1) / (n + v + 1)) / (count[w] + m)
    first = [10 ** got[1000 + i] / end(w) for i, w in enumerate([*"abcde", "unknown"])] + [10 ** got[1006]]
    assert sum(first) == pytest.approx(1)


def test_context_helps_on_texts_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = ngram_scores.scores(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS own", "sum(base_score) / sum(n_tokens) AS base", "count(*) AS n").first()
    assert r.n > 50 and r.own > r.base + 0.3


def test_hot_keys_are_told_beyond_small_counters(spark):
    """50,000 near copies in one task: each sub-tile of their common keys has some BLOCK rows."""
    from corpusloom.llm import jaccard_join

    common = " ".join(f"w{i}" for i in range(30))
    rows = spark.range(50_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit(common + " x"), "id").alias("text"))
    keys = jaccard_join._prefixes(rows, 80).select(F.explode(F.arrays_zip("keys", "salts")).alias("t")).groupBy("t.keys", "t.salts").count()
    most, tiles = keys.where("salts > 0").agg(F.max("count"), F.count("*")).first()
    assert most <= 2 * jaccard_join.BLOCK and tiles >= 50_000 / jaccard_join.BLOCK
    assert keys.where("salts = 0").agg(F.max("count")).first()[0] <= 2 * jaccard_join.BLOCK


@pytest.mark.parametrize("shuffle", [1, 9])
def test_counts_are_added_up_one_by_one(spark, shuffle):
    from corpusloom.llm.common import added_up, squeezed, unsqueezed

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
    rows = [(k, i % 2 == 0, bytearray(squeezed(np.arange(5) * 10**i + k))) for i in range(12) for k in range(3)]
    got = {(r.key, r.even): unsqueezed(bytes(r.counts)).tolist() for r in added_up(spark.createDataFrame(rows, "key int, even boolean, counts binary").repartition(7)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {(k, e): sum(np.arange(5) * 10**i + k for i in range(12) if (i % 2 == 0) == e).tolist() for k in range(3) for e in (True, False)}


def test_packing_joins_many_counts_by_a_shuffle(spark, monkeypatch):
    from corpusloom.llm import packing

    pieces = spark.createDataFrame([(i, i % 7 + 1) for i in range(500)], "doc_id long, length long").repartition(5)
    for most in (packing.MOST_SENT, 0):
        monkeypatch.setattr(packing, "MOST_SENT", most)
        got = packing.pack(pieces, 10).collect()
        assert len(got) == 500 and len({(r.sequence_id, r.offset) for r in got}) == 500
        room = Counter()
        for r in got:
            room[r.sequence_id] += r.length
        assert max(room.values()) <= 10
        for s, total in room.items():
            assert sorted((r.offset, r.length) for r in got if r.sequence_id == s)[-1][0] < total
