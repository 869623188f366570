"""Token ids in blocks of separately compressed documents that share one trained zstandard dictionary.

A store is a folder with two Parquet tables, so that any file system Spark reaches can hold it and a lost executor only
repeats its own blocks:

``dictionary``  one row: ``dict_hash`` (sha256, hex), ``bytes_per_id``, ``dictionary`` (binary, may be empty)
``blocks``      one row per block of neighbouring documents in ascending doc_id order: ``shard`` and ``block`` (the
                order), ``first_doc_id``, ``last_doc_id``, ``dict_hash``, ``doc_ids``, ``n_tokens``, ``ends`` (offset
                index: where each document's frame ends in ``payload``) and ``payload`` (the frames, one after another)

Null texts count as empty; every document, also an empty one, ends with the end id.  Rows with a null doc_id come first;
rows that repeat a doc_id are all kept, side by side.  An empty table gives a store without blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.word_bpe import encoder

BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2000, 8 << 20, 64 << 10
BLOCK_SCHEMA = (
    "shard int, block int, first_doc_id long, last_doc_id long, dict_hash string, doc_ids array<long>, "
    "n_tokens array<long>, ends array<long>, payload binary"
)


def _serialize(ids: bytes, bytes_per_id: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if bytes_per_id == 2 else ids


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, bytes_per_id: int, seed: int = 42) -> bytes:
    """A dictionary from about ``SAMPLE_DOCS`` documents chosen by hash; raw content if they are too few to train on."""
    import zstandard

    total = docs.count()
    if not total:
        return b""
    share = min(1.0, 1.5 * SAMPLE_DOCS / total)
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = _serialize(words.encode(text) + tail, bytes_per_id)[:SAMPLE_BYTES // 8]  # training only: no text fills the sample
                yield pa.record_batch([pa.array([ids], pa.binary())], ["ids"])

    samples, size = [], 0
    for row in docs.where(unit < share).select("text").mapInArrow(encode, "ids binary").limit(SAMPLE_DOCS).toLocalIterator():
        samples.append(bytes(row.ids))
        size += len(row.ids)
        if size > SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, bytes_per_id: int = 2, level: int = 3) -> str:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order; gives the folder.

    Two bytes per id are enough for ids up to 65535; a larger vocabulary or end id takes four, whatever ``bytes_per_id`` says.
    """
    if max(end_id, encoder(tokenizer_path).highest()) >> 16:
        bytes_per_id = 4
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer_path, end_id, bytes_per_id)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytes_per_id, bytearray(dictionary))], "dict_hash string, bytes_per_id int, dictionary binary").coalesce(
        1).write.parquet(f"{folder}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words, tail = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        shard, block = TaskContext.get().partitionId(), 0
        ids, counts, ends, frames, size = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            values = [[shard], [block], [min(known, default=None)], [max(known, default=None)], [dict_hash], [ids], [counts], [ends], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [part.split()[0] for part in BLOCK_SCHEMA.split(", ")]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words.encode(text.as_py()) + tail
                frame = packer.compress(_serialize(tokens, bytes_per_id))
                size += len(frame)
                ids.append(doc_id)
                counts.append(len(tokens) // 4)
                ends.append(size)
                frames.append(frame)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield close()
                    block += 1
                    ids, counts, ends, frames, size = [], [], [], [], 0
        if ids:
            yield close()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    return folder


def _reader(spark: SparkSession, folder: str):
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, dict_hash, width = bytes(row.dictionary), row.dict_hash, row.bytes_per_id
    if hashlib.sha256(dictionary).hexdigest() != dict_hash:
        raise ValueError(f"the dictionary of {folder} does not have the hash it is stored under")

    def unpacker():
        import zstandard

        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def tokens(unpack, block_hash: str, frame: bytes) -> bytes:
        if block_hash != dict_hash:
            raise ValueError(f"a block of {folder} was written with another dictionary: {block_hash}")
        raw = unpack.decompress(frame)
        return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw

    return unpacker, tokens


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard, shard_start)``: ids before each shard, from one small row per written shard."""
    totals = (
        spark.read.parquet(f"{folder}/blocks").groupBy("shard")
        .agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).orderBy("shard").collect()
    )
    before = np.concatenate([[0], np.cumsum([r.n for r in totals])]).astype(int)
    return spark.createDataFrame([(r.shard, int(b)) for r, b in zip(totals, before)], "shard int, shard_start long")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    unpacker, tokens = _reader(spark, folder)
    within = shard_starts(spark, folder).join(
        spark.read.parquet(f"{folder}/blocks").select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")), "shard")
    from pyspark.sql import Window

    order = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = within.select("shard", "block", (F.col("shard_start") + F.coalesce(F.sum("n").over(order), F.lit(0))).alias("block_start"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = unpacker()
        for batch in batches:
            for row in batch.to_pylist():
                begin, start, out = 0, row["block_start"], ([], [], [], [])
                for doc_id, n, end in zip(row["doc_ids"], row["n_tokens"], row["ends"]):
                    ids = tokens(unpack, row["dict_hash"], row["payload"][begin:end])
                    if len(ids) != 4 * n:
                        raise ValueError(f"document {doc_id} has {len(ids) // 4} ids, its index says {n}")
                    for column, value in zip(out, (doc_id, start, n, zlib.crc32(ids))):
                        column.append(value)
                    begin, start = end, start + n
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "dict_hash", "doc_ids", "n_tokens", "ends", "payload")
    return blocks.join(F.broadcast(starts) if _few(starts) else starts, ["shard", "block"]).select(
        "block_start", "dict_hash", "doc_ids", "n_tokens", "ends", "payload").mapInArrow(
        digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _few(starts: DataFrame, limit: int = 1_000_000) -> bool:
    return starts.count() <= limit


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of a few documents: only their blocks are read and only their frames are unpacked."""
    unpacker, tokens = _reader(spark, folder)
    wanted = sorted(set(doc_ids))
    near = F.lit(False)
    for doc_id in wanted:
        near = near | ((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, chosen = unpacker(), set(wanted)
        for batch in batches:
            for row in batch.to_pylist():
                begins = [0, *row["ends"]]
                hits = [i for i, d in enumerate(row["doc_ids"]) if d in chosen]
                ids = [np.frombuffer(tokens(unpack, row["dict_hash"], row["payload"][begins[i]:begins[i + 1]]), "<u4").tolist() for i in hits]
                yield pa.record_batch([pa.array([row["doc_ids"][i] for i in hits], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").where(near).select("dict_hash", "doc_ids", "ends", "payload")
    return blocks.mapInArrow(pick, "doc_id long, ids array<long>")
