"""Operator 6: SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary goes on past a whitespace marker once other characters have begun, and
none holds a line break (both are checked of the model that is loaded). So a text falls into
chunks, runs of spaces with the word after them and single line breaks, that are segmented
independently of each other.

The table is made in Spark: chunks are counted over all texts, tasks first, and the SHARED most frequent
ones (a fixed number, so that the table has a bound) are segmented once and sent to the workers. What a
worker meets besides is segmented there and kept in its own table, which is emptied at a fixed size; that costs time and no
exactness. Ids are put back by position. With all chunks in the shared table, positions would have
to be shuffled and joined: a row a word, three times the input and more (see the README).

A model that fails the check has whole texts encoded instead.

Cases: a null text is empty, has no ids and decodes to the empty text. Very long texts are taken whole.
Repeated rows give repeated results, null ids stay null, an empty table gives no rows. Extra columns are kept by ``encode`` and
``decode``, but for one named like the result, and ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.chunks import ChunkTable, hashes
from corpusloom.llm.common import freed, in_slices, lean, table
from corpusloom.llm.shingles import bytes_of

#: Chunks of the table that is sent to all workers, and bytes of the longest one in it.
SHARED, LONGEST = 100_000, 64
#: Bytes of text whose chunks are looked up at once, and chunks counted at once.
ROOM, COUNTED = 1 << 18, 1 << 17
_MARK = "▁"


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunk_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each that isn't empty led by a space; where chunks begin; and the number of chunks before each text, with the total."""
    data, begins = bytes_of(texts)
    # the model's own marker, where a text holds it, reads as a space
    if _MARK.encode() in data.tobytes():
        data, begins = bytes_of(pa.array([None if t is None else t.replace(_MARK, " ") for t in texts.to_pylist()], pa.string()))
    some = begins[:-1][np.diff(begins) > 0]
    data = np.insert(data, some, 32)
    begins = begins + np.searchsorted(some, begins)
    line, space = data == 10, data == 32
    first = np.empty(len(data), bool)
    first[:1] = True
    if len(data):
        # a space after another goes on with it, and a word goes on with the spaces before it
        first[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
    first[begins[:-1][np.diff(begins) > 0]] = True
    at = np.flatnonzero(first)
    return data, at, np.searchsorted(at, begins)


class Codec:
    """Encodes texts exactly as the model does, without begin and end ids."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.separable = not any(re.search(f"[^{_MARK}]{_MARK}|\n", p) for p in pieces) and self._marks_spaces()
        self.line = self.sp.encode("\n")[-1]
        #: What ids stand for within a text; those of single bytes are decoded by the library, in their chunk.
        self.texts = [p.replace(_MARK, " ") if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)) else "\0" for i, p in enumerate(pieces)]
        self.texts[self.line] = "\n"
        #: By chunk: its ids, the same in decimal with a comma after each, and what they decode to.
        self.table = ChunkTable(self.segmented, ["<i4", "u1", "u1"], room=1 << 25)

    def _marks_spaces(self) -> bool:
        """A space is put before a text and spaces are kept, as chunks take for granted."""
        p = self.sp.encode_as_pieces
        return "".join(p("a  b ")) == "▁a▁▁b▁" and self.sp.decode(self.sp.encode("\nx"))[:1] == "\n"

    def segmented(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The chunks' rows; the model sees them as lines of one text: no piece crosses a line break, and no other chunk holds one."""
        lines = [c for c in chunks if c != b"\n"]
        got = []
        if lines:
            ids = np.array(self.sp.encode(b"\n" + b"\n".join(lines)), np.int32)
            texts = "".join(map(self.texts.__getitem__, ids.tolist())).split("\n")[1:]
            of = [i[1:] for i in np.split(ids, np.flatnonzero(ids == self.line))[1:]]
            spelt = [i for i, text in enumerate(texts) if "\0" in text]
            for i, text in zip(spelt, self.sp.decode([[self.line, *of[i].tolist()] for i in spelt]) if spelt else [], strict=True):
                texts[i] = text[1:]
            got = [_row(i, text) for i, text in zip(of, texts, strict=True)]
        rows = iter(got)
        return [_row(np.array([self.line], np.int32), "\n") if c == b"\n" else next(rows) for c in chunks]

    def _looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at, of = chunk_starts(texts)
        return self.table.entries(data, at, *hashes(data, at)), of

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins, with the total."""
        if not self.separable:
            got = self.sp.encode(["" if t is None else t for t in texts.to_pylist()], num_threads=1)
            return np.array([i for ids in got for i in ids], np.int32), np.cumsum([0, *map(len, got)])
        entries, of = self._looked_up(texts)
        ids, to = self.table.joined(0, entries)
        return ids, to[of]

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of ids, the ids in decimal with commas, and what they decode to in UTF-8, of each text."""
        if not self.separable:
            ids, to = self.encode(texts)
            for i, j in zip(to[:-1], to[1:], strict=True):
                own = ids[i:j].tolist()
                yield len(own), ",".join(map(str, own)).encode(), self.decode(own).encode()
            return
        entries, of = self._looked_up(texts)
        number = np.diff(self.table.ends[0])[entries]
        counts = np.concatenate([[0], np.cumsum(number)])[of]
        digits, d = self.table.joined(1, entries)
        decoded, t = self.table.joined(2, entries)
        digits, decoded, d, t = memoryview(digits), memoryview(decoded), d[of].tolist(), t[of].tolist()
        for i, n in enumerate(np.diff(counts).tolist()):
            # decoding leaves out the space that encoding put before the text
            yield n, digits[d[i] : max(d[i], d[i + 1] - 1)], decoded[min(t[i] + 1, t[i + 1]) : t[i + 1]]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


def _row(ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    digits = ("%d," * len(ids) % tuple(ids.tolist())).encode()
    return ids, np.frombuffer(digits, np.uint8), np.frombuffer(text.encode(), np.uint8)


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One a worker and model."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of up to LONGEST bytes with their number; whenever COUNTED distinct ones are held they are passed on."""
    held: dict[bytes, int] = {}

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], names=["chunk", "n"])

    for whole in batches:
        for b in in_slices(whole, 512, ROOM):
            data, at, _ = chunk_starts(b.column("text"))
            h, first, n = np.unique(hashes(data, at)[0], return_index=True, return_counts=True)
            to = np.append(at, len(data))
            for i, k in zip(first.tolist(), n.tolist(), strict=True):
                if k > 1 and to[i + 1] - to[i] <= LONGEST:  # one that a slice holds once isn't frequent
                    chunk = data[to[i] : to[i + 1]].tobytes()
                    held[chunk] = held.get(chunk, 0) + k
            if len(held) > COUNTED:
                yield given()
                held.clear()
    yield given()


def frequent_chunks(docs: DataFrame, model_file: str, most: int = SHARED) -> list[tuple[np.ndarray, np.ndarray]]:
    """The most frequent chunks and their rows of the table, each segmented once, in a task: of each column its values on end and their sizes."""
    names = ("chunk", "ids", "digits", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = codec(model_file).segmented(b.column("chunk").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("chunk"), *(pa.array([r[p].tobytes() for r in rows], pa.binary()) for p in range(3))], names=names)

    counted = docs.select("text").where("text <> ''").mapInArrow(_counted, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    # a report of the most frequent: SHARED rows of LONGEST bytes at most
    top = counted.orderBy(F.desc("n"), "chunk").limit(most).select("chunk").mapInArrow(run, ", ".join(f"{n} binary" for n in names)).toArrow()
    out = []
    for name, kind in zip(names, ("u1", "<i4", "u1", "u1"), strict=True):
        values = top.column(name).to_pylist()
        out.append((np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize))
    return out


def encode(docs: DataFrame, model_file: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of every text."""
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in in_slices(whole, 512, ROOM, text_col):
                ids, begins = codec(model_file).encode(b.column(text_col))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))], names=[*b.schema.names, to])

    docs = docs.drop(to)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, model_file: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text of every list of ids; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in in_slices(whole, 512):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec(model_file).decode(i or []) for i in b.column(ids_col).to_pylist()], pa.string())], names=[*b.schema.names, to])

    docs = docs.drop(to)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())]))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass, so that no ids cross to the JVM."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model_file)
        made.table.start_with(shared.value)
        for whole in batches:
            for b in in_slices(whole, 512, ROOM):
                of = [(n, sha256(ids).hexdigest(), sha256(text).hexdigest()) for n, ids, text in made.digests(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*of, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        freed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_model())


QUERIES = {"op6_piece_codec": op6_piece_codec}
ORACLE: dict[str, str] = {}
