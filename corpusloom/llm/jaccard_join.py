"""Operator 8: n-gram Jaccard join for near duplicates.

A document's set is its distinct word shingles, as 64-bit hashes in order. Rows with equal sets
are one class; classes of Jaccard similarity of at least ``percent`` are linked, and the result is
each document's component.

Tiles are keyed by a shingle and run over sizes. Sets of similarity t share a shingle among their first
n - ceil(t n) + 1 in any one order of all shingles, so a class goes to the tiles of those alone.
The order is by frequency class, then hash: a fixed-size table of counts, summed over all
documents, makes passages that many documents share come last, so they open no tiles; the
table's collisions cost time but lose no pair. Within a tile rows are sorted by size and banded: a
band spans the sizes that can be similar to its smallest set. A key whose count shows that it is
hot is salted into sub-tiles of about BLOCK rows, and their heads meet in a tile of their own.

Links are looked for in two steps. First each class against the heads of its bands, which
joins nearly all of a group of copies in linear time; then, in tiles that still hold two components,
all pairs of different components. In both, bitmap signatures of hashed shingles bound the overlap
from above: a bit that one set has and the other lacks is an element not shared. What remains is
intersected exactly, as sorted arrays. The second step begins with rounds in which each row goes to one
block of its tile, drawn by chance, and only the likeliest pair of each component there is tried: they cost what
the tiles have rows, and join most of what the heads left apart. Then a tile of more than a block is cut into blocks
of its largest component and of the others; only pairs of blocks with one of the others are compared, so
a large component is never held against itself. That last step grows with the rows outside of the largest
component times all rows of a tile, as no pair may be lost.

Cases: null and empty texts have no shingles and link with nothing, each is its own component.
Rows are nodes: repeated rows are one class, and rows that share an id but not their text link each
by its own text. A row with a null id takes part; a component's id is its least id that isn't null, or
null. Very long texts are taken whole. An empty table gives no rows. Extra columns are ignored by
``near_duplicates`` and kept by ``deduplicated``; their names may be any but those that begin with ``_``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import added_up, cut, discard, freed, in_slices, lean, parts, squeezed, table, with_mark, without
from corpusloom.llm.components import components, extended
from corpusloom.llm.shingles import mixed, shingle_sets

PERCENT = 80
#: Counters of the frequency table, and the parts in which they are summed.
COUNTERS, COUNTER_PARTS = 1 << 23, 64
SIGNATURE_BYTES = 256
#: Rows of a sub-tile of a hot key, and log2 of it; rows of a block within a torn tile.
BLOCK, BLOCK_CLASS, PAIR_BLOCK = 2048, 11, 512
#: Bytes and rows of texts whose sets are held at once.
ROOM, SLICE = 1 << 18, 256
#: For the rounding of margins in doubles; what passes is intersected exactly.
SLACK = 1e-6
#: Rounds of likeliest pairs at most, while tiles hold more than PER_ROW pairs a row; the last is one in which not every MANYth pair links. What they leave is for the last step.
BEST_ROUNDS, PER_ROW, MANY = 3, 16, 20
#: Pairs of texts that one partition takes.
PAIRS = 256
#: Keys of rows that go, or repeat, which are sent to all tasks; of more a bitmap is sent, and the rows that it marks are shuffled.
MOST_SENT = 1 << 19


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.uint32)
    for whole in batches:
        for b in in_slices(whole, SLICE, ROOM):
            for s in shingle_sets(b.column("text")):
                total[(s & np.uint64(COUNTERS - 1)).astype(np.int64)] += np.uint32(1)  # of two shingles of one text and counter one counts
    for i, part in enumerate(total.reshape(COUNTER_PARTS, -1)):
        # what a task met once is no passage, and most of what fills a table too small for all shingles
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeezed(np.where(part == 1, 0, part))], pa.binary())], names=["part", "counts"])
    del total, part
    freed()


def _class_of(total: np.ndarray) -> bytes:
    return np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """log2 of the documents counted under each counter: one byte a counter, COUNTERS bytes."""
    counted = docs.select("text").mapInArrow(_count_shingles, "part int, counts binary")
    got = {r["part"]: bytes(r["counts"]) for r in added_up(counted, _class_of).collect()}
    empty = bytes(COUNTERS // COUNTER_PARTS)
    return np.frombuffer(b"".join(got.get(i, empty) for i in range(COUNTER_PARTS)), np.uint8)


def signature(s: np.ndarray) -> bytes:
    bits = np.zeros(8 * SIGNATURE_BYTES, np.uint8)
    bits[(s >> np.uint64(40)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).tobytes()


def _text_key() -> list[Column]:
    """What a row is known by wherever its text is needed again."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_k"), F.xxhash64("text").alias("_th")]


def _prefixes(docs: DataFrame, percent: int) -> DataFrame:
    """For each row, under a row number: n, digest, signature, and the shingles of its tiles with their salts (0: the key isn't hot)."""
    classes = frequency_classes(docs)
    # a key is hot above a block and above twice what counters hold anyhow, as keys that share one
    usual = int(np.median(classes)) + 1
    sent = docs.sparkSession.sparkContext.broadcast((classes, max(BLOCK_CLASS, usual)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of, warm = sent.value
        for whole in batches:
            for b in in_slices(whole, SLICE, ROOM):
                sets = shingle_sets(b.column("text"))
                keys, salts, digests = [], [], []
                for s in sets:
                    n = len(s)
                    most = n - -(-percent * n // 100) + 1 if n else 0
                    own = table_of[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    first = np.argsort(own, kind="stable")[:most]  # s ascends, so ties are by hash
                    keys.append(s[first].view(np.int64))
                    digest = xxhash.xxh3_128_digest(s.tobytes()) if n else None
                    digests.append(digest)
                    over = np.maximum(own[first].astype(np.int64) - warm, 0)
                    salts.append(np.where(over, 1 + (int.from_bytes(digest[:7], "little") & ((1 << over) - 1)), 0) if over.any() else np.zeros(most, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c) for c in ("rid", "doc_id", "_k", "_th")), pa.array(map(len, sets), pa.int32()), pa.array(digests, pa.binary()),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int64())),
                    ],
                    names=["rid", "doc_id", "_k", "_th", "n", "digest", "bits", "keys", "salts"],
                )
        freed()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *_text_key(), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, _k long, _th long, n int, digest binary, bits binary, keys array<long>, salts array<long>")


def _heads(n: list[int], doc: list[int], percent: int) -> list[int]:
    """The head of each row's band, of one tile's rows by size."""
    out, head, least = [], 0, -1
    for size, d in zip(n, doc, strict=True):
        if least < 0 or percent * size > 100 * least:
            head, least = d, size
        out.append(head)
    return out


def _banded(percent: int):
    """Of rows sorted by (key, salt, n, doc): tiles of two rows or more, and hot ones, with each row's head.

    Tiles of the same rows hold the same pairs and get the same number, so that one stands for all. Sub-tiles of
    a hot key share the key's. A tile's rows are held together: about BLOCK, or what two counters hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "salt", "n", "doc")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            done = int(new[-1]) if len(new) else 0
            yield from found([c[:done] for c in cols], np.concatenate([[0], new]))
            held = [c[done:] for c in cols]
        if held is not None:
            yield from found(held, np.array([0, len(held[0])]))

    def found(cols: list[np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(edges) < 2 or not edges[-1]:
            return
        key, salt, n, doc = cols
        own = mixed(doc.view(np.uint64) + np.uint64(1))
        sums = np.add.reduceat(own, edges[:-1]).view(np.int64)
        rows = np.diff(edges)
        hot = salt[edges[:-1]] > 0
        number = np.where(hot, key[edges[:-1]], sums)
        take = np.flatnonzero((rows > 1) | hot)
        if not len(take):
            return
        at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in take])
        heads = np.concatenate([_heads(n[edges[i] : edges[i + 1]].tolist(), doc[edges[i] : edges[i + 1]].tolist(), percent) for i in take])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(number[take], rows[take])), pa.array(np.repeat(hot[take], rows[take])), pa.array(n[at], pa.int32()), pa.array(doc[at]), pa.array(heads, pa.int64())], names=["tile", "hot", "n", "doc", "head"]
        )

    return run


def _bands(rows: DataFrame, percent: int) -> DataFrame:
    """tile, hot, n, doc, head of rows (key, salt, n, doc)."""
    ordered = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "doc")
    return ordered.mapInArrow(_banded(percent), "tile long, hot boolean, n int, doc long, head long")


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, np.empty(0, np.uint64)
        for whole in batches:
            for b in in_slices(whole, SLICE, ROOM, "x"):
                ids = b.column("b").to_numpy()
                new = np.flatnonzero(np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]]))  # rows come in order of b
                ys = shingle_sets(b.column("y").take(pa.array(new)))
                keep, at = [], -1
                for i, s in enumerate(shingle_sets(b.column("x"))):
                    if at + 1 < len(new) and new[at + 1] == i:
                        at += 1
                        other = ys[at]
                    # 100 i >= p (s + t - i)
                    keep.append((100 + percent) * len(np.intersect1d(s, other, assume_unique=True)) >= percent * (len(s) + len(other)))
                last = ids[-1]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, base: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of the written pairs (a, b) those that are similar, by exact intersection; a written table.

    Only texts of the pairs are shuffled and their sets made again, as a set takes three times the room of its text.
    """
    wanted = base.select("rid", "_k", "_th").join(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "rid")
    wanted = cut(wanted.withColumn("_tk", F.xxhash64("_k", "_th")), "wanted")
    rows = docs.where("text is not null").select(*_text_key(), "text").withColumn("_tk", F.xxhash64("_k", "_th"))
    texts = with_mark(rows, "_tk", wanted.select("_tk")).where("_marked").groupBy("_k", "_th").agg(F.first("text").alias("text"))
    # pairs go to the texts by these' own key, so that a text is dealt out once, and once more to meet the other
    keyed = pairs
    for c in ("a", "b"):
        keyed = keyed.join(wanted.select(F.col("rid").alias(c), F.col("_k").alias(f"_k{c}"), F.col("_th").alias(f"_th{c}")), c)
    x, y = (texts.select(F.col("_k").alias(f"_k{c}"), F.col("_th").alias(f"_th{c}"), F.col("text").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    met = keyed.join(x, ["_ka", "_tha"]).join(y, ["_kb", "_thb"])
    dealt = met.select("a", "b", "x", "y").coalesce(parts(pairs.count(), PAIRS))
    links = cut(dealt.mapInArrow(_linked(percent), "a long, b long"), "links")
    discard(wanted)
    return links


def _margin(n_a: np.ndarray, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """How far above the similarity asked for signatures allow a pair to be, below 0 if they don't.

    A bit of one set alone is an element that isn't shared.
    """
    shared = np.minimum(n_a - np.bitwise_count(bits_a & ~bits_b).sum(axis=1), n_b - np.bitwise_count(bits_b & ~bits_a).sum(axis=1))
    return (100 + percent) * shared / (n_a + n_b) - percent


def _bits_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SIGNATURE_BYTES // 8)


def _filtered(percent: int):
    """Of rows (a, n_a, bits_a, b, n_b, bits_b) the pairs that signatures allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = [b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")]
                keep = _margin(n[0], _bits_of(b.column("bits_a")), n[1], _bits_of(b.column("bits_b")), percent) >= -SLACK
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tile_pairs(percent: int, best: bool):
    """Rows come by tile and size; pairs of a tile's rows of different components whose signatures allow the similarity.

    With ``best``, only the pair of widest margin of each of the tile's components.
    """

    def pairs(cols: dict[str, np.ndarray], at: int, to: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n, doc, label, block = (cols[c][at:to] for c in ("n", "doc", "label", "block"))
        bits, two = cols["bits"][at:to], cols["t1"][at] != cols["t2"][at]
        top: dict[int, tuple[float, int, int]] = {}
        for i in range(to - at - 1):
            end = int(np.searchsorted(n, 100 * int(n[i]) // percent, side="right"))
            j = np.arange(i + 1, end)
            j = j[label[j] != label[i]]
            if two:
                j = j[block[j] != block[i]]
            if not len(j):
                continue
            margin = _margin(n[i], bits[i], n[j], bits[j], percent)
            allowed = margin >= -SLACK
            j, margin = j[allowed], margin[allowed]
            if not len(j):
                continue
            if best:
                for k in np.lexsort((-margin, label[j]))[np.unique(np.sort(label[j]), return_index=True)[1]]:
                    pair = (float(margin[k]), int(doc[i]), int(doc[j[k]]))
                    for own in (int(label[i]), int(label[j[k]])):
                        if own not in top or pair > top[own]:
                            top[own] = pair
            else:
                out.append((np.full(len(j), doc[i]), doc[j]))
        for _, a, b in set(top.values()):
            out.append((np.array([a]), np.array([b])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c).to_numpy().astype(np.int64) for c in ("tile", "t1", "t2", "n", "doc", "label", "block")} | {"bits": _bits_of(b.column("bits"))}
            if held is not None:
                cols = {c: np.concatenate([held[c], v]) for c, v in cols.items()}
            new = np.flatnonzero((cols["tile"][1:] != cols["tile"][:-1]) | (cols["t1"][1:] != cols["t1"][:-1]) | (cols["t2"][1:] != cols["t2"][:-1])) + 1
            edges = [0, *new.tolist()]
            yield _found(cols, edges, pairs)
            held = {c: v[edges[-1] :] for c, v in cols.items()}  # the last tile may go on: two blocks at most
        if held is not None:
            yield _found(held, [0, len(held["tile"])], pairs)

    return run


def _found(cols: dict[str, np.ndarray], edges: list[int], pairs) -> pa.RecordBatch:  # noqa: ANN001
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at, to in zip(edges, edges[1:], strict=False):
        pairs(cols, at, to, out)
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def _heads_met(members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a row and the head of one of its bands, and of heads of a hot key's sub-tiles, that signatures allow."""
    tops = members.where("hot and doc = head").select(F.col("tile").alias("key"), F.lit(0).cast("long").alias("salt"), "n", "doc")
    pairs = members.select("doc", "head").unionAll(_bands(tops, percent).select("doc", "head")).where("doc <> head")
    pairs = pairs.select(F.greatest("doc", "head").alias("a"), F.least("doc", "head").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    return pairs.select("a", "n_a", "bits_a", "b", "n_b", "bits_b").mapInArrow(_filtered(percent), "a long, b long")


def _torn(labelled: DataFrame) -> DataFrame:
    """Of tiles that hold several components the largest one and both counts of rows; a written table."""
    each = labelled.groupBy("tile", "label").agg(F.count("*").alias("rows"))
    tiles = each.groupBy("tile").agg(F.max_by("label", F.struct("rows", "label")).alias("major"), F.max("rows").alias("top"), F.sum("rows").alias("rows"), F.count("*").alias("several")).where("several > 1")
    return cut(tiles.select("tile", "major", "top", "rows"), "torn")


def _relabelled(labelled: DataFrame, tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the tiles that were torn, with the labels that theirs have been given since; a written table, for ``labelled``, which goes."""
    rows = labelled.join(tiles.select("tile"), "tile", "left_semi").join(labels.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label", "left")
    out = cut(rows.select("tile", "n", "doc", F.coalesce("_to", "label").alias("label")), "tiles")
    discard(labelled)
    return out


def _in_tiles(labelled: DataFrame, tiles: DataFrame, bits: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Candidate pairs (a, b) in the tiles that hold several components.

    In round ``best`` of the likeliest pairs a row goes to one block of its tile, drawn anew each round; with None to all
    that it must meet, where a tile of PAIR_BLOCK rows is one block.
    """
    rows = labelled.join(tiles, "tile").join(bits.select(F.col("id").alias("doc"), "bits"), "doc")
    if best is not None:
        block = F.pmod(F.xxhash64("doc", F.lit(best)), F.ceil(F.col("rows") / PAIR_BLOCK)).cast("int")
        rows = rows.withColumn("block", block).withColumn("other", F.col("block"))
    else:
        minors, majors = F.ceil((F.col("rows") - F.col("top")) / PAIR_BLOCK).cast("int"), F.ceil(F.col("top") / PAIR_BLOCK).cast("int")
        is_major, one = F.col("label") == F.col("major"), F.col("rows") <= PAIR_BLOCK
        block = F.when(one, 0).when(is_major, minors + F.pmod(F.xxhash64("doc"), majors)).otherwise(F.pmod(F.xxhash64("doc"), minors)).cast("int")
        rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(one, 1).when(is_major, minors).otherwise(minors + majors) - 1)))
    dealt = rows.select("tile", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"), "block", "doc", "label", "n", "bits")
    ordered = dealt.repartition("tile", "t1", "t2").sortWithinPartitions("tile", "t1", "t2", "n", "doc")
    return ordered.mapInArrow(_tile_pairs(percent, best is not None), "a long, b long").distinct()


def _labels(base: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, label) of the classes that are linked."""
    # rows that aren't their class's first are few or told by a bitmap, so keys aren't shuffled to leave them out
    copies = cut(base.select("rid", "digest").join(classes.select("digest", "rep"), "digest").where("rid <> rep.rid").select("rid"), "copies")
    heads = without(base.where("n > 0").select("rid", "n", "keys", "salts"), "rid", copies)
    rows = heads.select(F.col("rid").alias("doc"), "n", F.explode(F.arrays_zip("keys", "salts")).alias("t")).select(F.col("t.keys").alias("key"), F.col("t.salts").alias("salt"), "n", "doc")
    members = cut(_bands(rows, percent).distinct(), "tiles")
    bits = cut(base.select(F.col("rid").alias("id"), "n", "bits").join(members.select(F.col("doc").alias("id")).distinct(), "id", "left_semi"), "bits")
    seen = [cut(_heads_met(members, bits, percent), "pairs")]
    links = _verified(seen[0], base, docs, percent)
    labels = components(links)
    discard(links)
    # members meet their labels once; later rounds go on from the tiles that are still torn
    labelled = cut(members.select("tile", "n", "doc").join(labels.select(F.col("id").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc")), "tiles")
    discard(members)
    # then the likeliest pair of each component of a tile's block for as long as that links many, then all pairs that are left
    going, rounds = True, 0
    while True:
        tiles = _torn(labelled)
        # a tile of one block would give the same pairs again
        drawn = tiles.where(F.lit(rounds == 0) | (F.col("rows") > PAIR_BLOCK))
        rows = tiles.agg(F.sum("rows")).first()[0]
        if rows is None:
            discard(tiles)
            break
        left = drawn.agg(F.sum((F.col("rows") - F.col("top")) * F.col("rows"))).first()[0] or 0
        best = going and rounds < BEST_ROUNDS and left > PER_ROW * rows
        tried = functools.reduce(DataFrame.unionAll, seen)
        found_in = _in_tiles(labelled, drawn if best else tiles, bits, percent, rounds if best else None)
        pairs = cut(found_in.join(tried, ["a", "b"], "left_anti"), "pairs")
        seen.append(pairs)
        n, found = pairs.count(), 0
        if n:
            links = _verified(pairs, base, docs, percent)
            found = links.count()
            labels = extended(labels, links)
            discard(links)
        if best and found:
            labelled = _relabelled(labelled, tiles, labels)
        discard(tiles)
        if not best:
            break
        going, rounds = n > 0 and MANY * found >= n, rounds + 1
    discard(labelled, bits, copies, *seen)
    return labels


def _joined(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Every row's facts (a written table), all written tables that are read, and by digest ``best``: of its component the row with the least id, nulls last, and least text hash."""
    lean(docs.sparkSession)
    base = cut(_prefixes(docs, percent), "shingles")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_th", "rid")
    classes = cut(base.where("n > 0").groupBy("digest").agg(F.min(row).alias("rep")), "classes")
    labels = _labels(base, classes, docs, percent)
    labelled = classes.join(labels.withColumnRenamed("id", "_rid"), F.col("rep.rid") == F.col("_rid"), "left").select("digest", "rep", F.coalesce("label", "rep.rid").alias("label"))
    best = labelled.groupBy("label").agg(F.min("rep").alias("best"))
    return base, labelled.join(best, "label").select("digest", "best"), [base, classes, labels]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text)."""
    base, by_class, _ = _joined(docs, percent)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return base.select("doc_id", "n", "digest").join(by_class, "digest", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of each component one row does: of the least id, nulls last.

    A row without words is linked with nothing and stays, but for repeats under its own id. Only rows that are repeated
    or, with very many such rows, that a bitmap can't rule out to go or to be repeated, are shuffled.
    """
    base, by_class, read = _joined(docs, percent)
    stays = F.col("n").eqNullSafe(0) | ((F.col("_k") == F.coalesce("best.doc_id", F.lit(-1))) & (F.col("_th") == F.col("best._th")))
    judged = base.select("_k", "_th", "n", "digest", "doc_id").join(by_class, "digest", "left").groupBy("_k", "_th")
    judged = judged.agg(F.max(stays).alias("_stays"), F.max(F.expr("doc_id is null and n = 0")).alias("_apart"), F.count("*").alias("_rows"))
    open_ = cut(judged.where("not _stays or (_rows > 1 and not _apart)").select("_k", "_th", "_stays", F.xxhash64("_k", "_th").alias("_tk")), "open")
    discard(*read)
    keyed = docs.select("*", *_text_key())
    known = open_.select("_k", "_th", "_stays")
    if open_.count() <= MOST_SENT:
        sure, unsure = None, keyed.join(F.broadcast(known), ["_k", "_th"], "left")
    else:
        marked = with_mark(keyed.withColumn("_tk", F.xxhash64("_k", "_th")), "_tk", open_.select("_tk"))
        sure = marked.where("not _marked").select(*docs.columns)
        unsure = marked.where("_marked").join(known, ["_k", "_th"], "left")
    free = unsure.where("_stays is null").select(*docs.columns)
    one = unsure.where("_stays").dropDuplicates(["_k", "_th"]).select(*docs.columns)
    return free.unionAll(one) if sure is None else sure.unionAll(free).unionAll(one)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}

ORACLE = {
    "op8_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), w AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM t
), s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS g
  FROM w
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), i AS (
  SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2
), e AS (
  SELECT a, b FROM i JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), c(a, b) AS (
  SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a
), m AS (
  SELECT c.a AS r, min(w.doc_id) AS other FROM c JOIN w ON w.r = c.b GROUP BY c.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, m.other) AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
}
