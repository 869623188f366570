"""Removal of long byte strings that occur more than once, by suffix sorting in shards.

Texts never meet whole.  Every string of ``length`` bytes has a key, the least hash of its inner windows; equal strings
have equal keys, so only strings under the same key need to be compared.  Neighbouring strings under one key form a piece
of text (their starts, plus the bytes the last one covers).

1. Each text gives its pieces' keys and places; keys that turn up once cannot repeat and go.
2. Texts with remaining places are cut into pieces.  Equal pieces are counted, and only one of them goes on.
3. Pieces are dealt by key into shards, and a shard of distinct pieces is suffix-sorted by ``induced_sort``: strings
   with a common prefix of ``length`` bytes beside them repeat.  A piece that occurs twice repeats as a whole; a key whose pieces
   are all equal needs no sorting.
4. What repeats is mapped back to every place of the piece, merged for each text and cut out.

A key with more than ``key_limit`` distinct pieces, or more than ``key_bytes`` of them, as under a passage that very many texts share
or a byte that many long texts repeat, would fill one task.  Its strings are told apart by their 128-bit hashes instead and
counted in a distributed way, which finds the same strings.

Rows that are wholly equal, id included, are counted first and take part once; such a text repeats from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import LONG_ROWS, forget_kept, rows_in_chunks, store
from tracewarden.llm.induced_sort import repeated_starts
from tracewarden.session import discard

LENGTH, WINDOW = 200, 32  # bytes of a repeated string, bytes of a hashed window inside it
SHARD_BYTES, KEY_LIMIT, KEY_BYTES = 4 << 20, 15_000, 16 << 20
RUN_BYTES = 1 << 18  # text whose windows are hashed at once: some hundred bytes of work arrays for each of its bytes
MULTIPLIER = 0xD6E8FEB86659FD93
CUT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_spans", T.LongType())])


def window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """A mixed polynomial hash of each ``window`` bytes (a power of two), modulo 2**64."""
    values = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    width = 1
    while width < window:
        values = values[:-width] * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + values[width:]
        width *= 2
    values ^= values >> np.uint64(32)
    values *= np.uint64(0x9FB21C651E98DF25)
    return values ^ (values >> np.uint64(28))


def sliding_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each ``width`` neighbours, and whether it is there twice; from disjoint blocks of powers of two."""
    n = len(values) - width + 1
    least = twice = None
    block, block_twice, size, at = values, np.zeros(len(values), bool), 1, 0
    while True:
        if width & size:
            part, part_twice = block[at:at + n], block_twice[at:at + n]
            if least is None:
                least, twice = part, part_twice
            else:
                twice = (least == part) | np.where(least < part, twice, part_twice)
                least = np.minimum(least, part)
            at += size
        if 2 * size > width:
            return least, twice
        left, right = block[:-size], block[size:]
        block_twice = (left == right) | np.where(left < right, block_twice[:-size], block_twice[size:])
        block = np.minimum(left, right)
        size *= 2


def key_runs(texts: list[bytes], length: int, window: int):
    """Runs of neighbouring starts with one key: ``(text number, start, starts, key, occurrences hint)``.

    The hint is 2 where two strings of the run itself may be equal, else 1.
    """
    texts = [t if len(t) >= length else b"" for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    width = length - window + 1
    least, twice = sliding_least(window_hashes(data, window), width)
    n = len(least)
    number = np.repeat(np.arange(len(lengths)), lengths)[:n]
    begins = np.cumsum(lengths) - lengths
    inside = np.arange(n) + length <= (begins + lengths)[number]
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | (number[1:] != number[:-1])
    run = np.cumsum(change) - 1
    heads = np.flatnonzero(change)
    starts = np.bincount(run, weights=inside).astype(np.int64)
    doubled = np.bincount(run, weights=twice & inside) > 0
    kept = starts > 0  # a run outside its text's last string has none
    heads, starts, doubled = heads[kept], starts[kept], doubled[kept]
    hint = 1 + (doubled | (starts > width))
    return number[heads], heads - begins[number[heads]], starts, least[heads].view(np.int64), hint


def _runs(length: int, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for part in rows_in_chunks([batch], RUN_BYTES):
                texts = part.column(2).to_pylist()
                number, start, starts, key, hint = key_runs(texts, length, window)
                which = pa.array(number)
                yield pa.record_batch(
                    [pa.array(key), part.column(0).take(which), part.column(1).take(which), pa.array(start.astype(np.int32)),
                     pa.array(starts.astype(np.int32)), pa.array(hint.astype(np.int32))], ["key", "place", "check", "start", "starts", "hint"])
    return rows


def _cut(length: int):
    """Pieces of each text; a task sends a piece it has seen before only as a count."""
    from xxhash import xxh3_128_digest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        names = ["key", "piece", "count", "bytes", "place", "check", "start"]
        seen: dict = {}

        def record(key, piece, count, data, place, check, start) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            return pa.record_batch([pa.array(c, k) for c, k in zip((key, piece, count, data, place, check, start), kinds)], names)

        def totals() -> Iterator[pa.RecordBatch]:
            more = [(key, piece, count) for (key, piece), count in seen.items() if count]
            seen.clear()
            if more:
                keys, pieces, counts = zip(*more)
                none = [None] * len(more)
                yield record(keys, pieces, counts, none, none, none, none)

        for batch in batches:
            for part in rows_in_chunks([batch], 1 << 20):
                out = ([], [], [], [], [], [], [])
                for place, check, text, found in zip(*[c.to_pylist() for c in part.columns]):
                    flat = np.array(found, np.int64).reshape(-1, 3)
                    for key, start, starts in flat.tolist():
                        data = text[start:start + starts + length - 1]
                        piece = xxh3_128_digest(data)
                        known = seen.get((key, piece))
                        seen[(key, piece)] = 0 if known is None else known + 1
                        for column, value in zip(out, (key, piece, 1 if known is None else 0, data if known is None else None, place, check, start)):
                            column.append(value)
                if out[0]:
                    yield record(*out)
                if len(seen) > 150_000:
                    yield from totals()
        yield from totals()
    return rows


def _sort_shards(length: int, shard_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        ids, pieces, counts, size = [], [], [], 0  # the shard: distinct pieces of whole keys
        group: dict = {}  # piece -> [count, bytes] of the key being read
        group_key = None

        def result(found: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["piece", "spans"])

        def end_key() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if len(group) == 1:
                (piece, (count, data)), = group.items()
                if count > 1:
                    yield result([(piece, [0, len(data)])])
                    group.clear()
                    return
            for piece, (count, data) in group.items():
                ids.append(piece)
                pieces.append(data)
                counts.append(count)
                size += len(data) + 1
            group.clear()

        def sort() -> Iterator[pa.RecordBatch]:
            nonlocal size
            flags, at, found = repeated_starts(pieces, length), 0, []
            for piece, data, count in zip(ids, pieces, counts):
                starts = len(data) - length + 1
                if count > 1:
                    found.append((piece, [0, len(data)]))
                else:
                    own = np.flatnonzero(np.diff(flags[at:at + starts].astype(np.int8), prepend=0, append=0))
                    if len(own):
                        spans = own.reshape(-1, 2)
                        spans[:, 1] += length - 1
                        found.append((piece, spans.ravel().tolist()))
                at += len(data) + 1
            ids.clear(), pieces.clear(), counts.clear()
            size = 0
            if found:
                yield result(found)

        for batch in batches:
            for key, piece, count, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if key != group_key:
                    yield from end_key()
                    group_key = key
                    if size > shard_bytes:
                        yield from sort()
                entry = group.setdefault(piece, [0, data])
                entry[0] += count
                if entry[1] is None:
                    entry[1] = data
        yield from end_key()
        if pieces:
            yield from sort()
    return rows


def _strings(length: int):
    """Every string of a piece by its hash."""
    from xxhash import xxh3_128_digest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for part in rows_in_chunks([batch], 1 << 20, 256):
                for piece, count, data in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    starts = range(len(data) - length + 1)
                    hashes = [xxh3_128_digest(data[i:i + length]) for i in starts]
                    yield pa.record_batch(
                        [pa.array([piece] * len(starts), pa.binary()), pa.array(starts, pa.int64()), pa.array([count] * len(starts), pa.int64()), pa.array(hashes, pa.binary())],
                        ["piece", "at", "count", "string"])
    return rows


def _spans_of_hot_keys(counted: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """``(piece, spans)`` for the pieces of keys that are too large for a task."""
    pieces = counted.join(hot, "key", "left_semi").groupBy("piece").agg(F.sum("count").alias("count"), F.max("bytes").alias("bytes"))
    strings = store(pieces.mapInArrow(_strings(length), "piece binary, at long, count long, string binary"), LONG_ROWS)
    repeated = strings.groupBy("string").agg(F.sum("count").alias("n")).where("n > 1").select("string")
    # at most one entry per byte of a piece
    return strings.join(repeated, "string").groupBy("piece").agg(
        F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + length))).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Two longs that tell every text apart: the id, and a hash that tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({
        "_bytes": text.cast("binary"), "_place": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_check": F.xxhash64(text)})


def _each_once(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``keyed`` without the repetitions of a row, and the keys of the rows that had any, or None."""
    again = store(keyed.groupBy("place", "check").count().where("count > 1").select("place", "check"))
    if not again.limit(1).count():
        discard(again)
        return keyed, None
    single = keyed.join(again, ["place", "check"], "left_anti").select(*keyed.columns)
    several = keyed.join(again, ["place", "check"], "left_semi").groupBy("place", "check").agg(F.first("bytes").alias("bytes"))
    return single.unionByName(several), again


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, key_limit: int = KEY_LIMIT, key_bytes: int = KEY_BYTES,
) -> DataFrame:
    """``(place, check, spans)``: byte spans to remove, flat and unmerged, of each text of ``docs`` that has any."""
    keyed = _keyed(docs).select(F.col("_place").alias("place"), F.col("_check").alias("check"), F.col("_bytes").alias("bytes"))
    keyed, again = _each_once(keyed.where(F.octet_length("bytes") >= length))
    runs = store(keyed.select("place", "check", "bytes").mapInArrow(
        _runs(length, window), "key long, place long, check long, start int, starts int, hint int"), LONG_ROWS)
    repeated = runs.groupBy("key").agg(F.sum("hint").alias("n")).where(F.col("n") > 1).select("key")
    places = runs.join(repeated, "key").groupBy("place", "check").agg(
        F.flatten(F.collect_list(F.array(F.col("key"), F.col("start").cast("long"), F.col("starts").cast("long")))).alias("found"))
    cut = store(keyed.join(places, ["place", "check"]).select("place", "check", "bytes", "found").mapInArrow(
        _cut(length), "key long, piece binary, count long, bytes binary, place long, check long, start int"), LONG_ROWS)
    discard(runs)
    counted = cut.where(F.col("count") > 0).select("key", "piece", "count", "bytes")
    sizes = cut.where((F.col("count") > 0) & F.col("place").isNotNull()).groupBy("key").agg(  # rows that brought their bytes
        F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size"))
    hot = store(sizes.where((F.col("n") > key_limit) | (F.col("size") > key_bytes)).select("key"))
    some_hot = bool(hot.limit(1).count())
    cool = counted.join(hot, "key", "left_anti") if some_hot else counted
    found = cool.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shards(length, shard_bytes), "piece binary, spans array<long>")
    sorted_ = store(found.unionByName(_spans_of_hot_keys(counted, hot, length)) if some_hot else found, LONG_ROWS)
    placed = cut.where(F.col("place").isNotNull()).select("piece", "place", "check", "start")
    found = placed.join(sorted_, "piece").select("place", "check", F.transform("spans", lambda x: x + F.col("start")).alias("spans"))
    if again is not None:
        whole = keyed.join(again, ["place", "check"], "left_semi").select("place", "check", F.array(F.lit(0).cast("long"), F.octet_length("bytes").cast("long")).alias("spans"))
        found = found.unionByName(whole)
    result = store(found.groupBy("place", "check").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    discard(cut, sorted_, hot, again)
    return result


def _outside(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """The bytes outside the spans, and how many separate runs they cover."""
    kept, n = [], []
    for text, flat in zip(data, spans):
        if flat is None or not len(flat):
            kept.append(text)
            n.append(0)
            continue
        pairs = np.asarray(flat, np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        reach = np.maximum.accumulate(pairs[:, 1])
        fresh = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
        begins, ends = pairs[fresh, 0], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(pairs) - 1]])]
        kept.append(b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)])))
        n.append(len(begins))
    return pd.DataFrame({"kept": kept, "n_spans": n})


@F.pandas_udf(CUT)
def cut_out(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return _outside(data, spans)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, key_limit: int = KEY_LIMIT, key_bytes: int = KEY_BYTES,
) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``; columns of these names are replaced.

    Removed is every byte covered by a string of ``length`` bytes that also starts elsewhere in the table, same text
    included.  Null texts count as empty; rows with a null doc_id take part; rows that are wholly equal are copies of each
    other.  An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in {"kept", "n_bytes", "n_removed", "n_spans"}]
    done = _with_spans(docs.select(*own), repeated_spans(docs, length, window, shard_bytes, key_limit, key_bytes)).withColumn("_cut", cut_out("_bytes", "_spans"))
    return done.select(
        *own, F.col("_cut.kept").alias("kept"), F.octet_length("_bytes").cast("long").alias("n_bytes"),
        (F.octet_length("_bytes") - F.octet_length("_cut.kept")).cast("long").alias("n_removed"), F.col("_cut.n_spans").alias("n_spans"))


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    found = spans.select(F.col("place").alias("_place"), F.col("check").alias("_check"), F.col("spans").alias("_spans"))
    return _keyed(docs).join(found, ["_place", "_check"], "left")


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text`` and ``n_chars`` counted anew; the columns stay the same.

    A character of which only some bytes remain is dropped.
    """
    done = _with_spans(docs, repeated_spans(docs, **options)).withColumn("_text", cut_text("_bytes", "_spans"))
    text = F.when(F.col("text").isNotNull(), F.col("_text"))
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


@F.pandas_udf(T.StringType())
def cut_text(data: pd.Series, spans: pd.Series) -> pd.Series:
    """The text outside the spans, cut and decoded in one worker; what the batch before has left is given back first."""
    forget_kept()
    return _outside(data, spans)["kept"].map(lambda b: b.decode("utf-8", "ignore"))
