"""Operator 2: Merkle fingerprints of documents.

A text is a tree: the root over sections (blocks ended by blank lines), a section over paragraphs
(lines), a paragraph over clauses (runs ended by punctuation; a run without any is cut every
CLAUSE_WORDS words). The split keeps every character, each node is the digest of its children
under a prefix of its level, and so two roots are equal exactly when the texts are (up to a
collision of 128-bit BLAKE2b). The fingerprint is the tree written down:

    root | section/section/...    a section:   paragraph;paragraph;...
                                  a paragraph: the 32-bit digests of its clauses, in hex

Trees are compared from the root down: equal branches end the descent, differing ones are opened,
and the differing clauses locate the edit (``edits``). Likeness is the Dice coefficient of the
two multisets of clauses: 1 for equal texts.

Cases: a null text is the empty text, of one empty tree. Two empty texts have likeness 1. Very long texts
are taken whole, in time linear in them. Rows with equal ids are ordered by text (and lie in one bucket, as ids are
expected to be unique), null ids come lowest. A single document is its own next one. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import in_slices, lean, partitions, table

CLAUSE_WORDS = 16
#: Buckets of ids for each shuffle partition, so that a few long texts even out.
BUCKETS_PER_PARTITION = 4
#: Bytes of text that are taken at once.
ROOM = 1 << 20

_SECTION = re.compile(r"(?<=\n\n)(?!\n)")
_CLAUSE = re.compile(r"[^.!?,;:]+[.!?,;:\s]*|[.!?,;:\s]+")
#: Possessive, so that a run is gone over once.
_WORDS = re.compile(r"\s*+(?:\S++\s++){%d}|.++" % CLAUSE_WORDS, re.S)


def clauses(paragraph: str) -> list[str]:
    """A paragraph's leaves; joined they are the paragraph."""
    out = []
    for c in _CLAUSE.findall(paragraph):
        if len(c) > 8 * CLAUSE_WORDS:
            out += _WORDS.findall(c)
        else:
            out.append(c)
    return out


def tree(text: str) -> tuple[str, list[list[list[str]]]]:
    """Root digest, and the clauses' short digests by section and paragraph."""
    root, sections = blake2b(b"root", digest_size=16), []
    for s in _SECTION.split(text):
        section, paragraphs = blake2b(b"section", digest_size=16), []
        for p in s.splitlines(keepends=True):
            leaves = [blake2b(c.encode(), digest_size=16).digest() for c in clauses(p)]
            section.update(blake2b(b"paragraph" + b"".join(leaves), digest_size=16).digest())
            paragraphs.append([x[:4].hex() for x in leaves])
        root.update(section.digest())
        sections.append(paragraphs)
    return root.hexdigest(), sections


def written(made: tuple[str, list[list[list[str]]]]) -> str:
    return made[0] + "|" + "/".join(";".join("".join(p) for p in s) for s in made[1])


def fingerprint(text: str) -> str:
    return written(tree(text))


def parsed(fp: str) -> tuple[str, list[list[list[str]]]]:
    root, _, rest = fp.partition("|")
    return root, [[re.findall("." * 8, p) for p in s.split(";")] for s in rest.split("/")]


def leaf_counts(made: tuple[str, list[list[list[str]]]]) -> Counter:
    return Counter(x for s in made[1] for p in s for x in p)


def likeness(a: tuple[str, Counter], b: tuple[str, Counter]) -> float:
    """Of (root, clause counts): 1 if the roots are equal, else the clauses' Dice coefficient."""
    if a[0] == b[0]:
        return 1.0
    small, large = sorted((a[1], b[1]), key=len)
    total = small.total() + large.total()
    return 2 * sum(min(n, large[x]) for x, n in small.items() if x in large) / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` in branches that differ from ``b``, found from the roots down.

    A branch is held against the same place and, if that differs, against all of b's branches of
    its level, so that an inserted section or paragraph doesn't mark those after it.
    """
    x, y = parsed(a), parsed(b)
    if x[0] == y[0]:
        return []
    whole = {str(s) for s in y[1]}
    paragraphs = {str(p) for s in y[1] for p in s}
    return [(i, j) for i, s in enumerate(x[1]) if str(s) not in whole for j, p in enumerate(s) if str(p) not in paragraphs]


def edited_text(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as many of ``other``'s first code points."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ascend by (bucket, id, text) with each bucket's forerunner first; a row's next document, by descending id, is the one before it."""
    bucket, before = None, None
    for whole in batches:
        for batch in in_slices(whole, 256, ROOM):
            out = []
            texts = batch.column("text").to_pylist()
            for b, ghost, doc, text in zip(batch.column("_bucket").to_pylist(), batch.column("_ghost").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                if b != bucket:
                    bucket, before = b, None
                made = tree(text)
                counts = (made[0], leaf_counts(made))
                if not ghost:
                    next_text, next_counts = before if before else (text, counts)
                    edited = edited_text(text, next_text)
                    changed = made if edited == text else tree(edited)
                    out.append((doc, len(text), sha256(edited.encode()).hexdigest(), written(made), written(changed), likeness(counts, (changed[0], leaf_counts(changed))), likeness(counts, next_counts)))
                before = (text, counts)
            if out:
                names = [f.split()[0] for f in FIELDS.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def with_next(docs: DataFrame) -> DataFrame:
    """The documents in buckets of neighbouring ids, each led by a copy of the document before it.

    Bucket bounds are quantiles of the ids (as many as the buckets, whatever the input), sent to the tasks as an
    array. One document a bucket, its highest, is repeated ahead of the bucket above, the highest of all
    ahead of the lowest; so a single shuffle of the texts serves, and no window runs over all rows.
    """
    spark = docs.sparkSession
    lean(spark)
    n = BUCKETS_PER_PARTITION * partitions(spark)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    marks = thin.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("q")).first()["q"] or []
    bounds = np.array(sorted(set(marks)), np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        """Bounds below the id; null ids are in the first bucket."""
        known = ids.notna().to_numpy()
        return pd.Series(np.where(known, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="left"), 0))

    own = thin.withColumn("b", bucket("doc_id"))
    tops = sorted((r["b"], r["top"]) for r in own.groupBy("b").agg(F.max("doc_id").alias("top")).collect())  # a row a bucket
    # which bucket each bucket's highest document also goes to
    leads = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops) if top is not None}
    lead_ids = np.array(sorted(leads), np.int64)
    lead_to = np.array([leads[x] for x in lead_ids.tolist()], np.int64)

    @F.pandas_udf("int")
    def lead(ids: pd.Series) -> pd.Series:
        """-1 for a document that leads no bucket."""
        if not len(lead_ids):
            return pd.Series(np.full(len(ids), -1))
        some = ids.fillna(0).to_numpy(np.int64)
        at = np.minimum(np.searchsorted(lead_ids, some), len(lead_ids) - 1)
        return pd.Series(np.where(ids.notna().to_numpy() & (lead_ids[at] == some), lead_to[at], -1))

    to = F.array(F.struct(F.col("_own").alias("_bucket"), F.lit(False).alias("_ghost")))
    copies = F.when(F.col("_lead") < 0, to).otherwise(F.concat(to, F.array(F.struct(F.col("_lead").alias("_bucket"), F.lit(True).alias("_ghost")))))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumns({"_own": bucket("doc_id"), "_lead": lead("doc_id")})
        .withColumn("_to", F.explode(copies))
        .select("doc_id", "text", "_to._bucket", "_to._ghost")
        .repartition(partitions(spark), "_bucket")
        .sortWithinPartitions("_bucket", F.desc("_ghost"), F.asc_nulls_first("doc_id"), "text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses."""
    return with_next(docs).mapInArrow(_rows, FIELDS)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_fingerprint": op2_fingerprint}
ORACLE: dict[str, str] = {}
