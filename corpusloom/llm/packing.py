"""Operator 4: best-fit-decreasing packing of token sequences.

Pieces are placed longest first, each into the open bin with the least room that still takes it;
a segment tree over remaining capacities finds that bin in logarithmic time. Since pieces of one
length are alike and bins of one remaining capacity too, the packing is carried out on the
histogram of lengths: at most ``capacity`` rows reach the driver, whatever the input, and
the result is that of best-fit decreasing over all pieces at once. It is written down as runs
(pieces of a length, by rank, to a range of bins at one offset). The task that cuts texts into pieces numbers them
by length as it writes them; a piece's rank is that number and the count of its length in the tasks before. So
rows are numbered where they lie: no rows are sorted or shuffled for it, and a frequent length is no task of its own.

Texts are tokenized by distinct words: the tokenizer's pre-tokenizer drops white space and its
patterns don't reach across it, so each distinct run between spaces and line breaks is encoded by
the library when a worker meets it first, and its ids are joined back by position.

Cases: a null text is empty and has the end id alone; a null id stays null. Very long texts are cut into
pieces and never held but for themselves. Repeated rows are packed each; among pieces of one length the order
is any. An empty table gives no rows. Extra columns are ignored by
``token_pieces`` and kept by ``pack``, whose own names (task, nth, sequence_id, offset and such with ``_``) they may not have.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.chunks import ChunkTable, hashes
from corpusloom.llm.common import cut, freed, in_slices, lean, table
from corpusloom.llm.shingles import bytes_of

CAPACITY = 4096
END_ID = 1
#: Rows (task, length) of counts that are sent to all tasks, at 24 bytes each; more are joined by a shuffle.
MOST_SENT = 1 << 20
#: Bytes of text whose words are looked up at once.
ROOM = 1 << 18


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of lower code points are encoded many at once, side by side.
_PLAIN, TOGETHER = "\u0250", 1000
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
#: Punctuation that ends a word is a token by itself after one of these, so the word serves with and without it.
_ENDING, _BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_ENDING[list(b".,!?;:%*#$&")] = True
_BEFORE[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTokens:
    """Ids of texts by a table of distinct words."""

    def __init__(self, file: str, end_id: int = END_ID) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.end = np.array([end_id], dtype="<u4")
        self.table = ChunkTable(self._made, ["<u4"])

    def _made(self, words: list[bytes]) -> list[tuple[np.ndarray]]:
        texts = [w.decode() for w in words]
        out: dict[int, np.ndarray] = {}
        plain = [i for i, w in enumerate(texts) if w and max(w) < _PLAIN]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            out |= zip(some, self._together([texts[i] for i in some]), strict=True)
        return [(out[i] if i in out else np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4"),) for i, w in enumerate(texts)]

    def _together(self, words: list[str]) -> list[np.ndarray]:
        """The words as one text; a token belongs to the word where it begins."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        at = np.searchsorted(np.array([o[0] for o in e.offsets], dtype=np.int64), ends)
        return np.split(np.array(e.ids, dtype="<u4"), at[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and where each text begins, with the total."""
        data, begins = bytes_of(texts)
        # the tokenizer lower-cases, so a word serves for all its cases in A-Z; its special tokens know theirs
        if b"<|" not in data.tobytes():
            data = _LOWER[data]
        blank = _BREAK[data]
        first = np.empty(len(data) + 1, bool)
        first[0] = True
        first[1:-1] = blank[:-1]
        first[begins] = True
        if len(data):
            # a word's last byte that isn't ending punctuation; what follows it is a word of its own
            stem = np.maximum.accumulate(np.where(_ENDING[data], -1, np.arange(len(data))))
            last = np.flatnonzero(~blank & np.append(blank[1:], True) | ~blank & first[1:])
            stem = stem[last]
            first[stem[(stem >= 0) & (stem < last) & _BEFORE[data[stem]]] + 1] = True
        at = np.flatnonzero(first[:-1] & ~blank)
        entries = self.table.entries(data, at, *hashes(data, at, blank), cut=b" \n")
        ids, to = self.table.joined(0, entries)
        ends = to[np.searchsorted(at, begins[1:])]
        return np.insert(ids, ends, self.end), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


_made: dict[tuple[str, int], WordTokens] = {}


def word_tokens(file: str, end_id: int) -> WordTokens:
    """One a worker."""
    if (file, end_id) not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        _made[file, end_id] = WordTokens(file, end_id)
    return _made[file, end_id]


PIECE = "doc_id long, piece int, start long, length long"
NUMBERS = "task int, nth long"


class Numbering:
    """Numbers a task's rows by length."""

    def __init__(self) -> None:
        self.task, self.met = pyspark.TaskContext.get().partitionId(), np.zeros(1, np.int64)

    def columns(self, length: np.ndarray) -> list[pa.Array]:
        """``task`` and ``nth`` of rows of these lengths."""
        size = int(length.max(initial=0)) + 1
        if size > len(self.met):
            self.met = np.concatenate([self.met, np.zeros(size - len(self.met), np.int64)])
        order = np.argsort(length, kind="stable")
        count = np.bincount(length, minlength=len(self.met))
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count)
        nth += self.met[length]
        self.met += count
        return [pa.array(np.full(len(length), self.task, np.int32)), pa.array(nth)]


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` (any columns, with length) with ``task`` and ``nth``; to be written before it is read for counts and ranks."""
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Numbering()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *own.columns(b.column("length").to_numpy().astype(np.int64))], names=[*names, "task", "nth"])

    return pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())]))


def _pieces(file: str, capacity: int, end_id: int, keep_ids: bool, id_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Numbering()
        for whole in batches:
            for b in in_slices(whole, 512, ROOM):
                ids, begins = word_tokens(file, end_id).encode(b.column("text"))
                size = np.diff(begins)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = np.append(begins[doc] + start, len(ids)).astype(np.int32)
                if keep_ids and id_bytes:
                    if len(ids) and int(ids.max()) >> 8 * id_bytes:
                        raise ValueError(f"ids need more than {id_bytes} bytes")
                    last = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at * id_bytes), pa.py_buffer(ids.astype(f"<u{id_bytes}"))])
                elif keep_ids:
                    last = pa.ListArray.from_arrays(pa.array(at), pa.array(ids.view(np.int32)))
                else:
                    flat = memoryview(ids).cast("B")
                    last = pa.array([zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), last, *own.columns(length)],
                    names=["doc_id", "piece", "start", "length", "ids" if keep_ids else "ids_crc32", "task", "nth"],
                )
        freed()

    return run


def token_pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, id_bytes: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ``ids`` (array), or ``ids_crc32`` in their place, and ``task`` and ``nth`` for ``pack``.

    With ``id_bytes`` ids are written as binary, little-endian numbers of so many bytes each; ``pack`` makes arrays of them again.
    """
    lean(docs.sparkSession)
    last = ("ids binary" if id_bytes else "ids array<int>") if keep_ids else "ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(file, capacity, end_id, keep_ids, id_bytes), f"{PIECE}, {last}, {NUMBERS}")


class OpenBins:
    """Which remaining capacities have open bins: a segment tree with the count of bins at its leaves."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if count:
            self.bins.setdefault(room, []).append((first, count))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        """A range of bins with that room."""
        ranges = self.bins[room]
        out = ranges.pop()
        if not ranges:
            del self.bins[room]
            self._mark(room, False)
        return out

    def _mark(self, room: int, on: bool) -> None:
        i = self.size + room
        self.some[i] = on
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length``."""
        i = self.size + length
        if self.some[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank from, pieces a bin, first bin, offset) of best-fit decreasing.

    Of equal lengths, a bin that has taken one and can take another is the tightest again, so a
    bin takes as many as fit before the next is looked for.
    """
    bins, runs, made = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                first, count, room = made, -(-left // (capacity // length)), capacity
                made += count
            else:
                first, count = bins.take(room)
            each = room // length
            full = min(count, left // each)
            over = left - full * each if full < count else 0
            over = min(over, each - 1)
            runs.append((length, rank, each, first, capacity - room))
            bins.add(room - each * length, first, full)
            used = full
            if over:
                bins.add(room - over * length, first + full, 1)
                used += 1
            bins.add(room, first + used, count - used)
            rank += full * each + over
            left -= full * each + over
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_bytes: int = 0) -> DataFrame:
    """``pieces`` (any columns, with length from 1 to capacity) with sequence_id and offset, without task and nth.

    ``pieces`` should be a written table with ``task`` and ``nth`` as ``token_pieces`` or ``numbered`` gives them, as it is read for the
    counts and again for the places; without these columns it is numbered and written here. ``id_bytes`` is that of binary ids.
    Runs are sent with the tasks: they are at most the pieces of one length and bin, and level off with the input (11,000 at 20 million pieces).
    """
    if "nth" not in pieces.columns:
        pieces = cut(numbered(pieces), "pieces")
    counts = pieces.groupBy("task", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    runs = best_fit(histogram, capacity)
    # a row a task of a length: the counts of the tasks before
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    if counts.count() <= MOST_SENT:
        begin = F.broadcast(begin)
    ranked = pieces.join(begin, ["task", "length"]).withColumn("_rank", F.col("nth") + F.col("_before"))
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    return _looked_up(ranked.select(*kept, "_rank"), runs, id_bytes)


def _lists_of(column: pa.Array, id_bytes: int) -> pa.Array:
    """Binary ids as arrays."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(f"<u{id_bytes}").astype(np.int32) if data is not None else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array((at - at[0]) // id_bytes, pa.int32()), pa.array(flat))


def _looked_up(ranked: DataFrame, runs: list[tuple[int, int, int, int, int]], id_bytes: int) -> DataFrame:
    """``ranked`` with its places, and binary ids as arrays, in one pass: a second Python operator would take a second worker a task."""
    table_of = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table_of[:, 0] << 44) | table_of[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            own = table_of[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            n = rank - own[:, 1]
            kept = [c for c in b.schema.names if c != "_rank"]
            columns = [_lists_of(b.column(c), id_bytes) if id_bytes and c == "ids" else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 3] + n // own[:, 2]), pa.array(own[:, 4] + n % own[:, 2] * length)], names=[*kept, "sequence_id", "offset"])

    kinds = [T.StructField("ids", T.ArrayType(T.IntegerType())) if id_bytes and f.name == "ids" else f for f in ranked.schema.fields if f.name != "_rank"]
    return ranked.mapInArrow(run, T.StructType([*kinds, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def packed_sequences(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id and its ids, in order of offset: what a trainer reads."""
    placed = pack(cut(token_pieces(docs, file, capacity, end_id), "pieces"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of one sequence: capacity ids at most
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizer(), keep_ids=False)
    placed = pack(cut(pieces, "pieces"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE: dict[str, str] = {}
