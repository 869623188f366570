"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

A shard holds the documents of one task up to ``SHARD_BYTES`` of text, in ascending order of their ids; no text and no posting
is shuffled to build it.  Each term of a shard is a row: its postings in compressed blocks of ``BLOCK`` with the last document
of each block and the block's competitive pairs of occurrences and document length.  Whatever the statistics of the whole
collection are later, the best score of a block is reached by one of these pairs, so a search works out exact block maxima
without opening a block.

A search goes through a shard in windows of documents.  Terms are ordered by the maximum of their list; those whose
maxima together cannot lift a document above the worst of the best ``k`` so far are non-essential.  Only essential lists bring
candidates.  A candidate is dropped as soon as its score with the maxima of the lists to come is not enough, first with those of
whole lists, then with those of the blocks that it would lie in; only blocks that still have candidates are decompressed.
The best of all shards are merged at the end.

Terms are the maximal runs of ASCII letters, ASCII digits and other than ASCII characters, with A-Z lower-cased.  A null text and a text
without terms hold nothing and are never found; rows that repeat a document id are documents of their own, as are query rows that
repeat an item id; null ids come last among equal scores.  Without documents or queries there are no rows.  A shard holds
at least one document however long; columns other than those named are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import forget_kept, rows_in_chunks, store, text_bytes
from tracewarden.session import discard, spread

BLOCK, SHARD_BYTES, WINDOW_DOCS = 128, 24 << 20, 4096
BATCH_TERMS = 200_000  # terms of the queries that travel with one round of tasks
INDEX_SCHEMA = "shard long, term binary, df int, lasts binary, ends binary, pairs binary, firsts binary, data binary, ids array<long>, lengths binary"
FOUND_SCHEMA = "query int, doc_id long, score long"
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text; no byte of a character outside ASCII is below 128, so bytes can be split instead of characters."""
    return text.translate(LETTERS).split()


class Numbers(dict):
    """Terms to numbers in order of their first look-up."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def competitive(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(block, tf, length)`` of the postings that no other posting of their block beats in both, by block and falling tf."""
    order = np.lexsort((length, -tf, block))
    block, tf, length = block[order], tf[order], length[order]
    floor = np.minimum.accumulate(length - block * (int(length.max(initial=0)) + 1))  # starts anew in each block
    kept = np.ones(len(block), bool)
    kept[1:] = (length - block * (int(length.max(initial=0)) + 1))[1:] < floor[:-1]
    return block[kept], tf[kept], length[kept]


def _narrow(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bytes a value needs in each block (as 0, 1, 2 for 1, 2, 4), and all values in each of the widths."""
    top = np.maximum.reduceat(values, starts)
    return (top > 0xFF).astype(int) + (top > 0xFFFF), [values.astype(t) for t in ("<u1", "<u2", "<u4")]


def unpack(data: bytes, count: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, occurrences)`` of a compressed block; ``before``: last document of the block ahead, or -1."""
    gap, tf = data[0] >> 4, data[0] & 15
    gaps = np.frombuffer(data, f"<u{1 << gap}", count, 1)
    return before + np.cumsum(gaps, dtype=np.int64), np.frombuffer(data, f"<u{1 << tf}", count, 1 + (count << gap)).astype(np.int64)


def build_shard(shard: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard: one without a term that lists the documents, then one for each term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    numbers, counts, found = Numbers(), [], []
    for i in order:
        own = terms_of(texts[i])
        counts.append(len(own))
        found.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
    lengths = np.array(counts, np.int64)
    names = ["shard", "term", "df", "lasts", "ends", "pairs", "firsts", "data", "ids", "lengths"]
    none = pa.nulls(1, pa.binary())
    yield pa.record_batch(
        [pa.array([shard], pa.int64()), none, pa.array([len(ids)], pa.int32()), none, none, none, none, none,
         pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([lengths.astype("<i8").tobytes()], pa.binary())], names)
    if not len(numbers):
        return
    key, tf = np.unique(np.concatenate(found) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    del found, key
    place = np.arange(len(term))
    new_term = np.concatenate([[True], term[1:] != term[:-1]])
    within = place - np.maximum.accumulate(np.where(new_term, place, 0))
    starts = np.flatnonzero(within % BLOCK == 0)
    stops = np.concatenate([starts[1:], [len(term)]])
    gaps = doc - np.where(new_term, -1, np.concatenate([[0], doc[:-1]]))
    gap_width, gap_values = _narrow(gaps, starts)
    tf_width, tf_values = _narrow(tf, starts)
    blocks = [bytes([g << 4 | w]) + gap_values[g][a:b].tobytes() + tf_values[w][a:b].tobytes()
              for g, w, a, b in zip(gap_width.tolist(), tf_width.tolist(), starts.tolist(), stops.tolist())]
    pair_block, pair_tf, pair_length = competitive(np.repeat(np.arange(len(starts)), stops - starts), tf, lengths[doc])
    pairs = np.stack([pair_tf, pair_length], axis=1).astype("<i8")
    first_pair = np.searchsorted(pair_block, np.arange(len(starts) + 1))
    first_block = np.searchsorted(term[starts], np.arange(len(numbers) + 1))
    sizes = np.cumsum([0] + [len(b) for b in blocks])
    lasts, df = doc[stops - 1].astype("<i4"), np.bincount(term, minlength=len(numbers))
    spelled = list(numbers)
    for at in range(0, len(numbers), 8192):
        rows: list[list] = [[] for _ in range(7)]
        for t in range(at, min(at + 8192, len(numbers))):
            a, b = first_block[t], first_block[t + 1]
            for column, value in zip(rows, (
                    spelled[t], int(df[t]), lasts[a:b].tobytes(), (sizes[a + 1:b + 1] - sizes[a]).astype("<i4").tobytes(),
                    pairs[first_pair[a]:first_pair[b]].tobytes(), (first_pair[a:b] - first_pair[a]).astype("<i4").tobytes(), b"".join(blocks[a:b]))):
                column.append(value)
        n = len(rows[0])
        yield pa.record_batch(
            [pa.array([shard] * n, pa.int64()), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[2:]),
             pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): rows of ``INDEX_SCHEMA``, to be read by ``search``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        shard, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in rows_in_chunks(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if ids and held + len(text) > shard_bytes:
                    yield from build_shard(shard, ids, texts)
                    shard, ids, texts, held = shard + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield from build_shard(shard, ids, texts)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(spread(picked).mapInArrow(rows, INDEX_SCHEMA))


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms of all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(v, "<i8") for v in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([int((n > 0).sum()) for n in lengths], pa.int64()), pa.array([int(n.sum()) for n in lengths], pa.int64())], ["docs", "terms"])

    shards = index.where("term is null").select("lengths").mapInArrow(count, "docs long, terms long")
    row = shards.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return int(row.docs or 0), int(row.terms or 0)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, length: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What ``tf`` occurrences in a document of ``length`` terms add for a weight of 1, in 64-bit integers rounded down."""
    m = 50 + 50 * length * docs // terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class PostingList:
    """One term's list in a shard; blocks are opened when asked for and kept while the shard is searched."""

    def __init__(self, term_weight: int, lasts: bytes, ends: bytes, pairs: bytes, firsts: bytes, data: bytes, lengths: np.ndarray, docs: int, terms: int):
        self.weight, self.data, self.lengths, self.docs, self.terms = term_weight, data, lengths, docs, terms
        self.lasts, self.ends = np.frombuffer(lasts, "<i4").astype(np.int64), np.frombuffer(ends, "<i4")
        pair = np.frombuffer(pairs, "<i8").reshape(-1, 2)
        self.block_best = np.maximum.reduceat(term_weight * impact(pair[:, 0], pair[:, 1], docs, terms), np.frombuffer(firsts, "<i4"))
        self.best = int(self.block_best.max())
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.count = 0

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """``(documents, scores)`` of a block."""
        held = self.opened.get(block)
        if held is None:
            raw = self.data[self.ends[block - 1] if block else 0:self.ends[block]]
            width = (1 << (raw[0] >> 4)) + (1 << (raw[0] & 15))
            doc, tf = unpack(raw, (len(raw) - 1) // width, int(self.lasts[block - 1]) if block else -1)
            held = self.opened[block] = doc, self.weight * impact(tf, self.lengths[doc], self.docs, self.terms)
        return held

    def between(self, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The blocks that may hold documents from ``low`` to below ``high``."""
        first = int(np.searchsorted(self.lasts, low))
        return [self.open(b) for b in range(first, min(int(np.searchsorted(self.lasts, high - 1)) + 1, len(self.lasts)))]

    def block_of(self, candidates: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lasts, candidates)

    def block_maxima(self, blocks: np.ndarray) -> np.ndarray:
        inside = blocks < len(self.lasts)
        return np.where(inside, self.block_best[np.minimum(blocks, len(self.lasts) - 1)], 0)

    def scores(self, candidates: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What this term adds to each candidate (ascending), opening only the blocks they lie in."""
        out = np.zeros(len(candidates), np.int64)
        inside = blocks < len(self.lasts)
        wanted = np.unique(blocks[inside])
        if len(wanted):
            opened = [self.open(int(b)) for b in wanted]
            doc, score = np.concatenate([o[0] for o in opened]), np.concatenate([o[1] for o in opened])
            at = np.minimum(np.searchsorted(doc, candidates), len(doc) - 1)
            out = np.where(inside & (doc[at] == candidates), score[at], 0)
        return out


def best_of_shard(lists: list[PostingList], n_docs: int, k: int, window: int = WINDOW_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, scores)`` of the ``k`` best, highest first, equal scores by ascending document; only scores above 0."""
    lists = sorted(lists, key=lambda x: x.best)
    upto = np.cumsum([0] + [x.best for x in lists])  # upto[j]: what the first j lists can add together
    top_doc, top_score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, n_docs, window):
        high = min(low + window, n_docs)
        essential = int(np.searchsorted(upto, floor, side="right")) - 1  # the lists before it cannot lift a document above the floor
        if essential == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for one in lists[essential:]:
            for doc, score in one.between(low, high):
                a, b = np.searchsorted(doc, (low, high))
                sums[doc[a:b] - low] += score[a:b]
        found = np.flatnonzero(sums)
        score = sums[found]
        doc = found + low
        for j in range(essential - 1, -1, -1):
            kept = score + upto[j + 1] > floor
            doc, score = doc[kept], score[kept]
            if not len(doc):
                break
            blocks = lists[j].block_of(doc)
            kept = score + lists[j].block_maxima(blocks) + upto[j] > floor
            doc, score, blocks = doc[kept], score[kept], blocks[kept]
            score = score + lists[j].scores(doc, blocks)
        kept = score > floor
        if kept.any():
            top_doc, top_score = np.concatenate([top_doc, doc[kept]]), np.concatenate([top_score, score[kept]])
            order = np.lexsort((top_doc, -top_score))[:k]
            top_doc, top_score = top_doc[order], top_score[order]
            if len(top_doc) == k:
                floor = int(top_score[-1])  # a later document of the same score has the larger id
    return top_doc, top_score


def _searched(queries: list[tuple[int, list[bytes]]], weights: dict[bytes, int], docs: int, terms: int, k: int):
    def shard_rows(ids: list, lengths: np.ndarray, lists: dict[bytes, PostingList]) -> Iterator[pa.RecordBatch]:
        for number, own in queries:
            here = [lists[t] for t in own if t in lists]
            if here:
                doc, score = best_of_shard(here, len(ids), k)
                yield pa.record_batch(
                    [pa.array([number] * len(doc), pa.int32()), pa.array([ids[i] for i in doc], pa.int64()), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, lengths, lists = None, [], np.zeros(0, np.int64), {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:  # its first row lists the documents
                    yield from shard_rows(ids, lengths, lists)
                    shard, ids, lengths, lists = row["shard"], row["ids"], np.frombuffer(row["lengths"], "<i8"), {}
                elif weights[row["term"]]:
                    lists[row["term"]] = PostingList(
                        weights[row["term"]], *(row[c] for c in ("lasts", "ends", "pairs", "firsts", "data")), lengths, docs, terms)
        yield from shard_rows(ids, lengths, lists)

    return rows


def query_terms(items: DataFrame) -> DataFrame:
    """``(item_id, terms)``: each item's distinct terms; items without any are left out."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches):
            own = [sorted(set(terms_of(t))) for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    picked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(rows, "item_id long, terms array<binary>").where(F.size("terms") > 0)


def _batches(queries: DataFrame, batch_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries in turns of at most ``batch_terms`` terms (or one query), so that a turn's size is bounded."""
    turn, held = [], 0
    for row in queries.toLocalIterator():
        if turn and held + len(row.terms) > batch_terms:
            yield turn
            turn, held = [], 0
        turn.append((row.item_id, [bytes(t) for t in row.terms]))
        held += len(row.terms)
    if turn:
        yield turn


def search(index: DataFrame, items: DataFrame, k: int = 50, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for each row of ``items`` (item_id, text)."""
    spark = index.sparkSession
    docs, terms = totals(index)
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in _batches(query_terms(items), batch_terms) if terms else ():
        wanted = spark.createDataFrame([(t,) for t in sorted({t for _, own in turn for t in own})], "term binary")
        lists = index.join(F.broadcast(wanted), "term", "left_semi")  # at most batch_terms, or those of one query
        df = {bytes(r.term): r.df for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weights = {t: weight(docs, n) for t, n in df.items()}
        queries = [(number, [t for t in own if t in weights]) for number, (_, own) in enumerate(turn)]
        rows = index.where("term is null").unionByName(lists.select(*index.columns))
        found = rows.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInArrow(
            _searched(queries, weights, docs, terms, k), FOUND_SCHEMA)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(number, item_id) for number, (item_id, _) in enumerate(turn)], "query int, item_id long")
        result = result.unionByName(store(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")))
    return result


def search_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Build the index of ``docs``, search it once and drop it."""
    index = build_index(docs)
    found = search(index, items, k)
    discard(index)
    return found
