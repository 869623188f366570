"""Near copies by 64-bit SimHash fingerprints and a Gray-ordered hierarchical index.

Fingerprints that differ in at most ``max_bits`` bits agree on at least one of ``max_bits + 1`` blocks of bits, so equal
blocks bring all candidates together.  Distinct fingerprints of one block value form a group; a group that is too large
is dealt again by blocks of its remaining bits, which loses no link.  Inside a group fingerprints are sorted by Gray
rank and put under a tree whose nodes hold the bits all their members share; a query adds up its differences from those bits
on the way down and drops a node with all its members once they pass the limit.  A group hands on one star per
component, never its pairs; components across groups come from distributed label rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import forget_kept, rows_in_chunks, store, text_bytes
from tracewarden.session import discard

SHINGLE_WORDS, HASH_SEED, MAX_BITS = 4, 42, 4
GROUP_LIMIT, DEAL_LEVELS = 20_000, 4
FAN_OUT, QUERY_CHUNK = 16, 256
LAST = (1 << 63) - 1  # stands for a null doc_id


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The XXH64 of all shingles of ``size`` words, one of all words if there are fewer; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, HASH_SEED)], "<u8")
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    begins, ends = starts[:len(words) - size + 1].tolist(), (starts[size:] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], HASH_SEED) for a, b in zip(begins, ends)), "<u8", len(begins))


def majority(hashes: np.ndarray) -> int:
    """The word of the bits that more than half of the hashes have; 0 without hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(place, check, fp)``: id (a null one comes last), hash of the text, fingerprint as a signed long; null texts count as empty."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in rows_in_chunks(batches):
            fps = np.array([fingerprint(t) for t in text_bytes(batch.column(2))], "<u8").view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps)], ["place", "check", "fp"])

    picked = docs.select(*place_and_check(), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(rows, "place long, check long, fp long")


def place_and_check() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("place"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("check")]


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray code: neighbours in that order differ in few bits."""
    rank = fps.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Tree over Gray-sorted fingerprints; level 0 are the leaves' own words, each upper node covers ``FAN_OUT`` below.

    A node keeps ``mask``, the bits in which all its members agree and that no node above it fixes already, and ``bits``,
    their values; differences under these masks add up along a path.
    """

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        low, high = fps[self.order], fps[self.order]  # bits set in all members, bits set in any member
        shared, values = [np.full(len(low), ~np.uint64(0))], [low]
        while len(low) > FAN_OUT:
            edges = np.arange(0, len(low), FAN_OUT)
            low, high = np.bitwise_and.reduceat(low, edges), np.bitwise_or.reduceat(high, edges)
            shared.append(~(low ^ high))
            values.append(low)
        self.masks, self.bits = [], []
        for level, (mask, value) in enumerate(zip(shared, values)):
            if level + 1 < len(shared):
                mask = mask & ~shared[level + 1][np.arange(len(mask)) // FAN_OUT]
            self.masks.append(mask)
            self.bits.append(value & mask)

    def search(self, words: np.ndarray, labels: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in sorted order) within ``max_bits``, without nodes that carry the query's label already.

        ``labels``: a component label for each sorted place; ``own``: the queries' labels.
        """
        node_labels = [labels]
        for _ in self.masks[1:]:
            below = node_labels[-1]
            edges = np.arange(0, len(below), FAN_OUT)
            low, high = np.minimum.reduceat(below, edges), np.maximum.reduceat(below, edges)
            node_labels.append(np.where(low == high, low, -1))
        top = len(self.masks) - 1
        nodes = len(self.masks[top])
        who, node = np.repeat(np.arange(len(words)), nodes), np.tile(np.arange(nodes), len(words))
        gone = np.zeros(len(who), np.int64)
        for level in range(top, -1, -1):
            gone = gone + np.bitwise_count((words[who] & self.masks[level][node]) ^ self.bits[level][node])
            keep = (gone <= max_bits) & (node_labels[level][node] != own[who])
            who, node, gone = who[keep], node[keep], gone[keep]
            if level:
                size = len(self.masks[level - 1])
                children = np.minimum(size - node * FAN_OUT, FAN_OUT)
                firsts = np.repeat(np.cumsum(children) - children, children)
                child = np.arange(children.sum()) - firsts
                who, gone, node = np.repeat(who, children), np.repeat(gone, children), np.repeat(node * FAN_OUT, children) + child
        return who, node


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links ``a - b``: each joined set takes its smallest label."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
        labels = parent[labels]


def group_components(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each distinct fingerprint the index of its component's first member in ``fps``."""
    index = GrayIndex(fps)
    words = fps[index.order]
    labels = np.arange(len(words))
    for at in range(0, len(words), QUERY_CHUNK):
        chunk = np.arange(at, min(at + QUERY_CHUNK, len(words)))
        who, found = index.search(words[chunk], labels, labels[chunk], max_bits)
        labels = merge_labels(labels, chunk[who], found)
    first = np.empty(len(words), np.int64)
    first[index.order] = index.order[labels]
    return first


def _stars(max_bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, []

        def star(parts: list[np.ndarray]) -> list[np.ndarray]:
            fps = np.concatenate(parts)
            if len(fps) < 2:
                return [fps[:0], fps[:0]]
            first = group_components(fps.view(np.uint64), max_bits)
            far = first != np.arange(len(fps))
            return [fps[far], fps[first[far]]]

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            out = []
            for k, part in zip(keys[np.concatenate([[0], cuts])] if len(keys) else [], np.split(fps, cuts)):
                if k != key and waiting:
                    out.append(star(waiting))
                    waiting = []
                key = k
                waiting.append(part)
            if out:
                a, b = (np.concatenate(c) for c in zip(*out))
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
        if waiting:
            a, b = star(waiting)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
    return rows


def _blocks(mask: int, parts: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in free[len(free) * i // parts:len(free) * (i + 1) // parts]) for i in range(parts)]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) whose components are those of all links."""
    spark = distinct.sparkSession
    rows = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("mask"))
    masks, ready = [0], []
    for level in range(DEAL_LEVELS):
        pairs = [(m, block) for m in masks for block in _blocks(m, max_bits + 1)]
        # a few hundred rows at most: the blocks follow from the level alone
        deal = F.broadcast(spark.createDataFrame([(_signed(m), _signed(b)) for m, b in pairs], "mask long, block long"))
        masks = sorted({m | b for m, b in pairs})
        dealt = rows.join(deal, "mask").select(
            "fp", F.xxhash64("key", "block", F.col("fp").bitwiseAND(F.col("block"))).alias("key"), F.col("mask").bitwiseOR(F.col("block")).alias("mask"))
        if level == DEAL_LEVELS - 1:
            ready.append(dealt)
            break
        large = dealt.groupBy("key").count().where(F.col("count") > group_limit).select("key")
        if not large.limit(1).count():
            ready.append(dealt)
            break
        large = store(large)
        ready.append(dealt.join(large, "key", "left_anti"))
        rows = dealt.join(large, "key", "left_semi")
    grouped = ready[0].select("key", "fp")
    for more in ready[1:]:
        grouped = grouped.unionByName(more.select("key", "fp"))
    return grouped.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars(max_bits), "a long, b long")


def _are_stars(links_: DataFrame) -> bool:
    """Whether every link (u, v), v the smaller node, leads to a root: no node has two of them, and none that is led to has any."""
    ends = links_.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links_.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    either = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return either.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b): the smallest node that its links reach.

    Rounds of two star steps: each node's larger neighbours are linked to its smallest neighbour, then each node's
    smaller neighbours among themselves to the smallest.  Every round is written out, and the one before dropped.
    """
    links_ = store(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(links_):
        both = links_.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links_.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = store(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        discard(links_)
        links_ = fresh
    # each link now leads to a root
    return links_.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links_.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _classes(docs: DataFrame, max_bits: int, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """Marked rows, and ``(fp, root, low)``: the class of each fingerprint and the smallest id place in it."""
    marked = store(fingerprints(docs))
    distinct = store(marked.groupBy("fp").agg(F.min("place").alias("first_place")))
    roots = components(links(distinct, max_bits, group_limit))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_place", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_place").alias("low"))
    classes = store(rooted.select("fp", "root").join(lowest, "root"))
    discard(distinct)
    return marked, classes


def near_copies(docs: DataFrame, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: the smallest doc_id that chains of near fingerprints reach.

    Every row of ``docs`` (doc_id, text) gives a row, repeated rows too.  Texts without words have fingerprint zero and are
    linked like any other; rows with a null doc_id take part, and a component of such rows alone has a null id.  An
    empty table gives no rows.
    """
    marked, classes = _classes(docs, max_bits, group_limit)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return marked.join(classes, "fp").select(
        known("place").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), known("low").alias("component_id"))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The rows of ``docs`` with one document of each component: one with the smallest doc_id, null ones being the largest.

    Of rows that share this doc_id the one with the smallest text hash stays, and one of rows that share that too.
    """
    return one_of_each(docs, *_classes(docs, max_bits, group_limit))


def one_of_each(docs: DataFrame, marked: DataFrame, classes: DataFrame) -> DataFrame:
    """``keep_one`` for rows ``marked`` (place, check, fp) of the classes ``(fp, root, low)``."""
    chosen = marked.join(classes, "fp").where(F.col("place") == F.col("low")).groupBy("root").agg(
        F.first("low").alias("_place"), F.min("check").alias("_check")).select("_place", "_check")
    place, check = place_and_check()
    keyed = docs.withColumns({"_place": place, "_check": check})
    return keyed.join(chosen, ["_place", "_check"], "left_semi").dropDuplicates(["_place", "_check"]).select(*docs.columns)
