"""Operator 12: language-model scores by a weighted backoff automaton.

The model is an n-gram model of words with hierarchical Dirichlet smoothing (MacKay and Peto, 1995): after a
context h that was seen c(h) times, p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), h' being h without its first
word and m the ``strength``; without context p(w) = (c(w) + 1) / (N + V + 1), so that all unknown words
together are one more. Probabilities after any context add up to 1 over the known words and an unknown one.
A text begins with a mark that is context only and ends with one that is a token.

As an automaton: each context seen is a state, each n-gram seen an arc with its log-probability to the longest
suffix that is a state, and a state's failure arc leads to the longest proper suffix with the weight
log(m / (c(h) + m)). A text is read from left to right; a word without an arc is looked for along failure arcs,
whose weights are added. Since a state is told by the last ``order`` - 1 words, a long text is read in
segments side by side, each after these words before it, which carry it to its state without being scored.

The model grows with the corpus, so nobody holds it whole. Texts are cut into slices of some
a million tokens (``Sizes``), written as word numbers with the hashes of their distinct words. A slice asks for
the counts of its own distinct n-grams, and gives those that it has itself in training texts: both in one message a slice and bucket of
hashes, six bytes an n-gram. A bucket, of as many texts' tokens whatever the input, adds up and answers in the same order.
Back at the slice the answers make the part of the automaton that its texts can reach, and they are read by it. As a slice
names an n-gram once however often it has it, no n-gram is more than one row a slice, and a hot word is no hot key.

N-grams are known by the bucket and 48 further bits of a hash; a bucket holds some 10 million n-grams at most, so
about one in 30 million shares its count with another, at any size of the corpus. With very many buckets
messages become small: beyond some 10 TB of text they hold few n-grams each, and their fixed part outweighs them.

Cases: a null or empty text has the end token alone. Training is told by crc32 of the id as text, a null id as the empty one. Repeated rows
count each. A very long text is taken whole: a worker holds some 60 bytes a token of it. Without training texts
N and V are 0, and every score is 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, freed, in_slices, lean, squeezed, table, unsqueezed
from corpusloom.llm.shingles import bytes_of, mixed, word_hashes

ORDER, STRENGTH = 2, 32.0
#: Bytes of text whose words are hashed at once.
ROOM = 1 << 20
#: The remainder of crc32(id) by 7 that isn't learned from.
MODULUS, HELD_OUT = 7, 2
#: Local numbers of the marks, and their hashes.
BEGIN, END, WORDS_FROM = 0, 1, 2
_MARKS = np.array([0x6265676E5F6D6172, 0x656E645F6D61726B], np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 48) - 1)


class Sizes(NamedTuple):
    """Tokens of a slice, of a bucket and of a segment; they change no result."""

    slice: int = 1 << 20
    bucket: int = 1 << 20
    segment: int = 64


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(MODULUS)) == HELD_OUT


SLICE = "slice long, ids array<long>, held array<boolean>, sizes binary, seq binary, words binary, tokens long"


def _sliced(slice_tokens: int):
    """Slices of rows (doc_id, held, text): each text's number of words, its words' local numbers, and the words' hashes by number."""

    def made(row: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SLICE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = pyspark.TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        tokens = 0

        def given() -> pa.RecordBatch:
            ids, own, sizes, flat = zip(*held, strict=True)
            words, seq, n = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which take less room
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return made([name, pa.concat_arrays(ids).to_pylist(), pa.concat_arrays(own).to_pylist(), squeezed(np.concatenate(sizes)), squeezed(rank[seq]), words[order].tobytes(), tokens])

        for whole in batches:
            for b in in_slices(whole, 4096, ROOM):
                hashes, ends = word_hashes(*bytes_of(b.column("text")))
                held.append((b.column("doc_id"), b.column("held"), np.diff(ends), hashes))
                tokens += len(hashes) + 2 * b.num_rows
                if tokens >= slice_tokens:
                    yield given()
                    name, tokens = name + 1, 0
                    held.clear()
        if held:
            yield given()
        freed()

    return run


class Slice:
    """A slice's tokens with marks, and its distinct n-grams by order.

    number[k]: at each place the local number of the k-gram that ends there, -1 where the text has too few tokens before.
    prefix[k], last[k], suffix[k]: of each distinct k-gram its first k - 1 tokens' number, its last token, its last k - 1 tokens' number.
    """

    def __init__(self, sizes: bytes, seq: bytes, words: bytes, order: int) -> None:
        sizes_, seq_ = unsqueezed(sizes), unsqueezed(seq)
        self.ends = np.cumsum(sizes_ + 2)
        self.begins = self.ends - sizes_ - 2
        self.tokens = np.full(int(self.ends[-1]) if len(sizes_) else 0, WORDS_FROM, np.int64)
        self.tokens[self.begins] = BEGIN
        self.tokens[self.ends - 1] = END
        self.tokens[self.tokens == WORDS_FROM] = seq_ + WORDS_FROM
        self.doc = np.repeat(np.arange(len(sizes_)), sizes_ + 2)
        self.order, hashes = order, np.concatenate([_MARKS, np.frombuffer(words, np.uint64)])
        self.words = len(hashes)
        self.number, self.hash = [np.empty(0, np.int64), self.tokens], [np.empty(0, np.uint64), hashes]
        self.prefix, self.last, self.suffix = [None, None], [None, None], [None, None]
        place = np.arange(len(self.tokens)) - self.begins[self.doc]
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 1)
            shorter = self.number[k - 1]
            distinct, first, number = np.unique(shorter[at - 1] * self.words + self.tokens[at], return_index=True, return_inverse=True)
            whole = np.full(len(self.tokens), -1, np.int64)
            whole[at] = number
            self.number.append(whole)
            self.prefix.append(distinct // self.words)
            self.last.append(distinct % self.words)
            self.suffix.append(shorter[at[first]])
            with np.errstate(over="ignore"):
                self.hash.append(mixed(self.hash[k - 1][self.prefix[k]] * _P + hashes[self.last[k]] + np.uint64(k)))
        # words first, then longer n-grams, each by bucket and hash: the order of messages and answers
        flat, longer = np.concatenate(self.hash), np.repeat([False, True], [self.words, sum(map(len, self.hash[2:]))])
        self.keys = np.lexsort((flat, longer))
        self.flat, self.longer = flat[self.keys], longer[self.keys]

    def by_bucket(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Each key's bucket, and the keys' order by bucket, words first, then hash."""
        bucket = (self.flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.flat), np.int64)
        return bucket, np.argsort(bucket, kind="stable")

    def counts(self, taken: np.ndarray) -> np.ndarray:
        """How often each key comes in the texts ``taken``."""
        own = taken[self.doc]
        each = [np.bincount(self.number[k][own & (self.number[k] >= 0)], minlength=len(self.hash[k])) for k in range(1, self.order + 1)]
        return np.concatenate(each)[self.keys]

    def by_order(self, counts: np.ndarray) -> list[np.ndarray]:
        """Counts of keys as those of local numbers, by order."""
        out = np.empty_like(counts)
        out[self.keys] = counts
        return [np.empty(0, np.int64), *np.split(out, np.cumsum([len(h) for h in self.hash[1:-1]]))]


def _asked(order: int, bits: int):
    """Messages (bucket, slice, words, lows, counts): the low bytes of hashes, ``words`` of them of single words, and the counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Slice(r["sizes"], r["seq"], r["words"], order)
                counts = s.counts(~np.array(r["held"], bool))
                bucket, by = s.by_bucket(bits)
                bucket, counts, longer = bucket[by], counts[by], s.longer[by]
                lows = np.ascontiguousarray((s.flat[by] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
                pairs = list(zip(edges, edges[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[i]) for i, _ in pairs], pa.int64()), pa.array([r["slice"]] * len(pairs), pa.int64()), pa.array([int((~longer[i:j]).sum()) for i, j in pairs], pa.int64()),
                        pa.array([lows[i:j].tobytes() for i, j in pairs], pa.binary()), pa.array([squeezed(counts[i:j]) for i, j in pairs], pa.binary()),
                    ],
                    names=["bucket", "slice", "words", "lows", "counts"],
                )
        freed()

    return run


ANSWER = "slice long, bucket long, counts binary, distinct long, total long"


def _answered(bits: int):
    """Rows come by bucket; for each message the sums in its order, and for each bucket, without a slice, its distinct training words and their tokens."""
    marks = [(int(h) >> (64 - bits) if bits else 0, int(h & _LOW)) for h in _MARKS]

    def answers(bucket: int, held: list[dict]) -> pa.RecordBatch:
        sizes = np.array([len(r["lows"]) // 6 for r in held])
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(r["lows"] for r in held), np.uint8).reshape(-1, 6)
        keys = wide.reshape(-1).view("<u8").astype(np.int64)
        words = np.array([r["words"] for r in held])
        begins = np.cumsum(sizes) - sizes
        longer = np.arange(len(keys)) - np.repeat(begins, sizes) >= np.repeat(words, sizes)
        keys |= longer.astype(np.int64) << 48
        distinct, number = np.unique(keys, return_inverse=True)
        each = np.concatenate([unsqueezed(r["counts"]) for r in held])
        total = np.bincount(number, weights=each, minlength=len(distinct)).astype(np.int64)  # doubles are exact to 2**53
        own = total[number]
        is_word = distinct < 1 << 48
        if marks[BEGIN][0] == bucket:
            is_word &= distinct != marks[BEGIN][1]
        ends = begins + sizes
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(r["slice"] for r in held), None], pa.int64()), pa.array([bucket] * (len(held) + 1), pa.int64()), pa.array([*(squeezed(own[i:j]) for i, j in zip(begins, ends, strict=True)), None], pa.binary()),
                pa.array([None] * len(held) + [int((is_word & (total > 0)).sum())], pa.int64()), pa.array([None] * len(held) + [int(total[is_word].sum())], pa.int64()),
            ],
            names=[c.split()[0] for c in ANSWER.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield answers(held[0]["bucket"], held)
                    held = []
                held.append(r)
        if held:
            yield answers(held[0]["bucket"], held)
        freed()

    return run


class Automaton:
    """The states and arcs that a slice's n-grams need, given their counts in training; state 0 has no context."""

    def __init__(self, s: Slice, counts: list[np.ndarray], n: int, v: int, strength: float) -> None:
        self.words = s.words
        prob = (counts[1] + 1) / (n + v + 1)
        self.known, self.base = counts[1] > 0, np.log10(prob)
        # states: contexts of order 1 to ``order`` - 1 that training has, numbered by order; the end mark is no context
        of, total = [np.zeros(1, np.int64)], 1
        for k in range(1, s.order):
            seen = counts[k] > 0
            seen &= (s.last[k] if k > 1 else np.arange(s.words)) != END
            own = np.where(seen, total + np.cumsum(seen) - 1, -1)
            of.append(own)
            total += int(seen.sum())
        self.fail, self.back = np.zeros(total, np.int64), np.zeros(total)
        self.begin = of[1][BEGIN] if s.order > 1 else 0
        # without context every word has an arc
        self.first = np.maximum(of[1], 0) if s.order > 1 else np.zeros(s.words, np.int64)
        keys, values, targets = [], [], []
        for k in range(1, s.order):
            seen = np.flatnonzero(of[k] >= 0)
            state = of[k][seen]
            if k > 1:
                self.fail[state] = of[k - 1][s.suffix[k][seen]]
            self.back[state] = np.log10(strength / (counts[k][seen] + strength))
        for k in range(2, s.order + 1):
            seen = np.flatnonzero(counts[k] > 0)
            before, suffix = s.prefix[k][seen], s.suffix[k][seen]
            longer = np.zeros(len(counts[k]))
            longer[seen] = (counts[k][seen] + strength * prob[suffix]) / (counts[k - 1][before] + strength)
            prob = longer
            target = np.maximum(of[k][seen] if k < s.order else -1, of[k - 1][suffix])
            keys.append(of[k - 1][before] * self.words + s.last[k][seen])
            values.append(np.log10(longer[seen]))
            targets.append(np.maximum(target, 0))
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        by = np.argsort(flat)
        self.keys = flat[by]
        self.values, self.targets = (np.concatenate(x)[by] if x else np.empty(0, np.int64) for x in (values, targets))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word leads from each state, and its log-probability there."""
        out, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        state = state.copy()
        while len(open_):
            own, w = state[open_], word[open_]
            free = own == 0
            some = open_[free]
            out[some] += self.base[w[free]]
            to[some] = self.first[w[free]]
            open_, own, w = open_[~free], own[~free], w[~free]
            if not len(open_):
                break
            key = own * self.words + w
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            some = open_[hit]
            out[some] += self.values[at[hit]]
            to[some] = self.targets[at[hit]]
            open_ = open_[~hit]
            out[open_] += self.back[own[~hit]]
            state[open_] = self.fail[own[~hit]]
        return to, out

    def scores(self, s: Slice, segment: int) -> np.ndarray:
        """Each text's log-probability: its segments are read side by side from left to right."""
        # scored are all tokens but the first mark
        size = s.ends - s.begins - 1
        count = -(-size // segment)
        doc = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = s.begins[doc] + 1 + nth * segment
        end = np.minimum(at + segment, s.ends[doc])
        start = np.maximum(at - max(s.order - 1, 1), s.begins[doc])
        order = np.argsort(start - end, kind="stable")  # longest first
        doc, at, end, start = doc[order], at[order], end[order], start[order]
        reach = end - start
        state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for t in range(int(reach.max(initial=0))):
            m = int(np.searchsorted(-reach, -t, side="left"))
            here = start[:m] + t
            state[:m], got = self.step(state[:m], s.tokens[here])
            total[:m] += np.where(here >= at[:m], got, 0.0)
        return np.bincount(doc, weights=total, minlength=len(size))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _read(order: int, strength: float, n: int, v: int, segment: int):
    """Rows come by slice and bucket: the slice itself first, then the answers to it."""

    def scored(own: dict, answers: list[bytes], bits: int) -> Iterator[pa.RecordBatch]:
        s = Slice(own["sizes"], own["seq"], own["words"], order)
        counts = np.empty(len(s.flat), np.int64)
        counts[s.by_bucket(bits)[1]] = np.concatenate([unsqueezed(a) for a in answers])
        automaton = Automaton(s, s.by_order(counts), n, v, strength)
        score = automaton.scores(s, segment)
        is_token = s.tokens != BEGIN
        tokens, of = s.tokens[is_token], s.doc[is_token]
        docs = len(s.ends)
        base = np.bincount(of, weights=automaton.base[tokens], minlength=docs)
        known = np.bincount(of, weights=automaton.known[tokens], minlength=docs).astype(np.int64)
        columns = [pa.array(own["ids"], pa.int64()), pa.array(own["held"], pa.bool_()), pa.array(np.bincount(of, minlength=docs)), pa.array(known), pa.array([n] * docs, pa.int64()), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict | None = None
        answers: list[bytes] = []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] < 0:
                    if own is not None:
                        yield from scored(own, answers, own["bits"])
                    own, answers = r, []
                else:
                    answers.append(r["counts"])
        if own is not None:
            yield from scored(own, answers, own["bits"])
        freed()

    return run


def scores(docs: DataFrame, learn: Column | None = None, order: int = ORDER, strength: float = STRENGTH, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """Of (doc_id, text): n_tokens, n_known, train_tokens, base_score (without context) and score of every row.

    ``learn`` tells the training rows, by default those that aren't ``held_out``; the column held_out is of the others.
    """
    lean(docs.sparkSession)
    taken = ~held_out(F.col("doc_id")) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~taken).alias("held"), "text")
    slices = cut(rows.mapInArrow(_sliced(sizes.slice), SLICE), "slices")
    tokens = slices.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    bits = max(0, (tokens // sizes.bucket).bit_length())
    messages = slices.select("slice", "held", "sizes", "seq", "words").mapInArrow(_asked(order, bits), "bucket long, slice long, words long, lows binary, counts binary")
    answers = cut(messages.repartition("bucket").sortWithinPartitions("bucket", "slice").mapInArrow(_answered(bits), ANSWER), "answers")
    all_ = answers.where("slice is null").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    own = slices.select("slice", F.lit(-1).cast("long").alias("bucket"), "ids", "held", "sizes", "seq", "words", F.lit(bits).alias("bits"))
    told = answers.where("slice is not null").select("slice", "bucket", "counts")
    both = own.unionByName(told, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "bucket")
    return both.mapInArrow(_read(order, strength, all_["n"] or 0, all_["v"] or 0, sizes.segment), SCORED)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op12_lm_scores": op12_lm_scores}
ORACLE: dict[str, str] = {}
