"""Operator 9: language identification by multinomial naive Bayes.

Features are character n-grams of 1 to 3 code points of the lower-cased text, hashed to BUCKETS
buckets. Training adds up bucket counts by language over every labelled training document: one
partial vector a language and task, added one by one as they come (``added_up``). The log-probability matrix has languages x
BUCKETS floats and is broadcast; it has MAX_LANGUAGES rows at most, and of more labels those of the fewest
documents are not learned. Scoring is sparse, in numpy: the matrix is gathered at a batch's buckets
and summed by document.

A sum of log-likelihoods over a whole text is far too sure of itself, as n-grams overlap. So the score is
the posterior under equal priors of log-likelihoods times t * n ** (a - 1), n being the text's n-grams. A part of the
training documents is held back from a first model, and t and a are those under which snippets of them, of SNIPPETS
code points, have the least log loss. Besides, each language's log-likelihood an n-gram over these
snippets has a mean and a spread by length: ``typical`` falls to 1/2 at FAR spreads below the mean, and the
score is the posterior times it. A text that no language made is so told from a short one.

A text that is null or has no letter (Unicode category L) is ``und`` with score 0.

Cases: an empty training set predicts ``und`` for all. Ties go to the smaller label. A null
id counts as the empty text in crc32, and so is in training. Repeated rows count each; very long texts are taken
whole. Of extra columns ``predict`` keeps all but those with its own names; ``train`` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import added_up, in_slices, lean, squeezed, table, texts_of, unsqueezed

BUCKETS = 1 << 15
ORDERS = 3
MAX_LANGUAGES = 1000
SMOOTHING = 0.5
#: Remainders of crc32(id) by 4: never learned from, and held back for calibration.
HELD_OUT, CALIBRATE = 2, 1
#: Code points of snippets for calibration, exponents and factors tried, and spreads below the mean at which ``typical`` is 1/2.
SNIPPETS = (4, 12, 40, 160, 640)
EXPONENTS, FACTORS, FAR = (0.0, 0.25, 0.5, 0.75, 1.0), tuple(2.0**i for i in range(-6, 7)), 12.0
LEAST_TYPICAL = 0.5
#: Snippets of a language and length from which a mean and a spread are taken.
FEW = 10
#: Languages that a training task holds before it passes them on.
HELD = 64
#: Bytes of text whose n-grams are held at once; a longer text is one part.
ROOM = 1 << 18
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, in order, and where each text begins.

    A space stands before and after each text; n-grams don't reach from one to the next.
    """
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in padded], dtype=np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # n-grams of the highest order begin at all places but a text's last two
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    at, hashes = code.copy(), []
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS + 1):
            if n > 1:
                at = at * np.uint32(0x01000193)
                at[: len(at) - n + 1] += code[n - 1 :]
            h = at ^ (at >> np.uint32(15))
            h = h * np.uint32(0x2C1B3C6D)
            h = ((h ^ (h >> np.uint32(13))) + np.uint32(n)) % np.uint32(BUCKETS)
            hashes.append(np.where(room >= n, h, BUCKETS).astype(np.int32))
    starts = (np.cumsum(sizes) - sizes) * ORDERS
    return np.stack(hashes, axis=1).reshape(-1), starts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, bool], np.ndarray] = {}

    def given() -> pa.RecordBatch:
        langs, back = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(back), pa.array(list(map(squeezed, held.values())), pa.binary())], names=["lang", "back", "counts"])

    for whole in batches:
        for b in in_slices(whole, 256, ROOM):
            texts, of = texts_of(b), list(zip(b.column("lang").to_pylist(), b.column("back").to_pylist(), strict=True))
            for key in set(of):
                h, _ = hashed_ngrams([t for t, own in zip(texts, of, strict=True) if own == key])
                got = np.bincount(h, minlength=BUCKETS + 1)[:BUCKETS]
                held[key] = held[key] + got if key in held else got
            if len(held) > HELD:
                yield given()
                held.clear()
    if held:
        yield given()


class Model:
    """Labels in order and the log-probabilities of buckets, languages x (BUCKETS + 1); the last, for no n-gram, is 0.

    mean, spread: of the log-likelihood an n-gram, by language and snippet length.
    """

    def __init__(self, labels: list[str], counts: np.ndarray) -> None:
        self.labels = labels
        logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
        self.logs = np.concatenate([logs, np.zeros((len(labels), 1))], axis=1).astype(np.float32)
        self.exponent, self.factor = 0.5, 1.0
        self.mean, self.spread = np.zeros((len(labels), len(SNIPPETS))), np.full((len(labels), len(SNIPPETS)), np.inf)

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods an n-gram, texts x languages, and the texts' n-grams."""
        h, starts = hashed_ngrams(texts)
        n = np.add.reduceat(h < BUCKETS, starts, dtype=np.int64)
        return np.stack([np.add.reduceat(row[h], starts, dtype=np.float64) for row in self.logs], axis=1) / n[:, None], n

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Label, score and ``typical`` of each text."""
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)] if self.labels else []
        if some:
            each, n = self.likelihoods([texts[i] for i in some])
            best = each.argmax(axis=1)
            top = each[np.arange(len(best)), best]
            share = 1 / np.exp((each - top[:, None]) * (self.factor * n**self.exponent)[:, None]).sum(axis=1)
            size = np.searchsorted(SNIPPETS, [len(texts[i]) for i in some], side="right") - 1
            size = np.maximum(size, 0)
            typical = 1 / (1 + np.exp(np.clip(-(top - self.mean[best, size]) / self.spread[best, size] - FAR, -50, 50)))
            for i, k, p, t in zip(some, best, share, typical, strict=True):
                out[i] = (self.labels[k], float(p * t), float(t))
        return out


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == HELD_OUT


def snippets(text: str) -> list[tuple[int, str]]:
    """Of each length that the text reaches one piece with a letter, from the text's middle; (place in SNIPPETS, piece)."""
    out = []
    for i, n in enumerate(SNIPPETS):
        at = (len(text) - n) // 2
        if at >= 0 and has_letter(piece := text[at : at + n]):
            out.append((i, piece))
    return out


def _calibrated(model: Model, rows: DataFrame) -> dict[int, float]:
    """Sums over the snippets of (text, lang): the log loss by exponent and factor, then count, sum and sum of squares by language and length."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    n_loss, n_sizes = len(EXPONENTS) * len(FACTORS), len(SNIPPETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at = {lang: i for i, lang in enumerate(own.labels)}
        loss, sums = np.zeros((len(EXPONENTS), len(FACTORS))), np.zeros((len(at), n_sizes, 3))
        for whole in batches:
            for b in in_slices(whole, 256, ROOM):
                got = [(at[lang], i, piece) for t, lang in zip(texts_of(b), b.column("lang").to_pylist(), strict=True) if lang in at for i, piece in snippets(t)]
                if not got:
                    continue
                lang, size = np.array([g[0] for g in got]), np.array([g[1] for g in got])
                each, n = own.likelihoods([g[2] for g in got])
                true = each[np.arange(len(got)), lang]
                for i, e in enumerate(EXPONENTS):
                    for j, f in enumerate(FACTORS):
                        s = (each - true[:, None]) * (f * n**e)[:, None]
                        most = s.max(axis=1)
                        loss[i, j] += (most + np.log(np.exp(s - most[:, None]).sum(axis=1))).sum()
                for p in range(3):
                    np.add.at(sums, (lang, size, p), true**p)
        flat = np.concatenate([loss.reshape(-1), sums.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    summed = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    assert len(summed) in (0, n_loss + len(model.labels) * n_sizes * 3)
    return {r["at"]: r["value"] for r in summed}


def train(labelled: DataFrame) -> Model:
    """From all rows of (doc_id, text, lang) with a label."""
    lean(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull()).select("text", "lang", (remainder(F.col("doc_id")) == CALIBRATE).alias("back"))
    most = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(most) > MAX_LANGUAGES:
        rows = rows.where(F.col("lang").isin(most[:MAX_LANGUAGES]))
    counted = rows.mapInArrow(_counts, "lang string, back boolean, counts binary")
    of = {(r["lang"], r["back"]): unsqueezed(bytes(r["counts"])) for r in added_up(counted).collect()}
    labels, none = sorted({lang for lang, _ in of}), np.zeros(BUCKETS, np.int64)
    front = np.array([of.get((lang, False), none) for lang in labels]).reshape(-1, BUCKETS)
    model = Model(labels, front + np.array([of.get((lang, True), none) for lang in labels]).reshape(-1, BUCKETS))
    if labels:
        got = _calibrated(Model(labels, front), rows.where("back").select("text", "lang"))
        if got:
            flat = np.array([got[i] for i in range(len(got))])
            n = len(EXPONENTS) * len(FACTORS)
            sums = flat[n:].reshape(len(labels), len(SNIPPETS), 3)
            if sums[:, :, 0].sum():
                best = int(flat[:n].argmin())
                model.exponent, model.factor = EXPONENTS[best // len(FACTORS)], FACTORS[best % len(FACTORS)]
            count = np.maximum(sums[:, :, 0], 1)
            model.mean = sums[:, :, 1] / count
            spread = np.sqrt(np.maximum(sums[:, :, 2] / count - model.mean**2, 0))
            # where there are few snippets the next shorter ones serve, which spread wider; without any all texts are typical
            model.spread = np.where(sums[:, :, 0] >= FEW, np.maximum(spread, 1e-3), np.inf)
            for i in range(1, len(SNIPPETS)):
                few = sums[:, i, 0] < FEW
                model.mean[few, i], model.spread[few, i] = model.mean[few, i - 1], model.spread[few, i - 1]
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and typical."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ("lang_pred", "score", "typical")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in in_slices(whole, 256, ROOM):
                got = shared.value.predict(texts_of(b))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), *(pa.array([g[i] for g in got], pa.float64()) for i in (1, 2))], names=[*b.schema.names, *own])

    docs = docs.drop(*own)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own[0], T.StringType()), *(T.StructField(c, T.DoubleType()) for c in own[1:])]))


def accepted() -> Column:
    """Of ``predict``'s columns: a language was told, and the text is one that it makes."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("typical") >= LEAST_TYPICAL)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    judged = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
