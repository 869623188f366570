"""Documents packed into training sequences: first-fit decreasing on a tournament tree of free space.

Documents are dealt to tasks by a hash, so every run of ``group_docs`` documents in a task is a random group; each group
is packed on its own and nothing waits for another group.  A document longer than a sequence is cut at multiples of the
sequence length; its rest is packed like a short document.  The last, half-empty sequences of a group are cut into powers of two,
which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import give_back
from tracewarden.llm.word_bpe import encoder

GROUP_DOCS, GROUP_TOKENS = 4096, 6_000_000
SENT_PIECES = 256  # pieces of at most one sequence that leave a task at once
LADDER_FILL = 0.97  # a sequence filled less than this is cut into powers of two


class TournamentTree:
    """Free space of bins in a complete binary tree; each inner node holds the larger of its children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """Put an item into the first bin that has room for it; gives the bin."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < length:
                node += 1
        best[node] -= length
        bin_, node = node - self.leaves, node // 2
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            top = left if left > right else right
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item; items of equal length keep their order."""
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i] = tree.place(lengths[i])
    return bins


def pack_group(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)`` of one group of documents with these token counts."""
    pieces, sequences = [], 0
    rests, rest_of = [], []
    for i, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((i, start, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rests.append(n % capacity)
            rest_of.append(i)
    bins: dict[int, list[int]] = {}
    for j, bin_ in enumerate(first_fit_decreasing(rests, capacity)):
        bins.setdefault(bin_, []).append(j)
    for members in bins.values():
        filled = sum(rests[j] for j in members)
        # binary ladder of a poorly filled bin: its lengths are powers of two
        cuts = [1 << b for b in reversed(range(filled.bit_length())) if filled >> b & 1] if filled < LADDER_FILL * capacity else [filled]
        room, offset = cuts.pop(0), 0
        for j in members:
            i, left = rest_of[j], rests[j]
            start = lengths[i] - left
            while left:
                if offset == room:
                    room, offset, sequences = cuts.pop(0), 0, sequences + 1
                step = min(left, room - offset)
                pieces.append((i, start, step, sequences, offset))
                start, left, offset = start + step, left - step, offset + step
        sequences += 1
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 4096, seed: int = 42) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset``.

    ``docs``: doc_id, text.  A null text is a document of the end id alone; rows that repeat a doc_id are packed each on
    its own; an empty table gives no pieces.  ``sequence_id`` is unique but has gaps between tasks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = docs.withColumn("_deal", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)))
    spread = dealt.repartition("_deal").sortWithinPartitions("_deal", "doc_id").select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        ids, tokens, size = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = pack_group([len(t) // 4 for t in tokens], length)
            for at in range(0, len(pieces), SENT_PIECES):
                part = pieces[at:at + SENT_PIECES]
                yield pa.record_batch([
                    pa.array([ids[i] for i, *_ in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()), pa.array([tokens[i][4 * s:4 * (s + n)] for i, s, n, *_ in part], pa.binary()),
                    pa.array([len(tokens[i]) // 4 for i, *_ in part], pa.int64()), pa.array([first + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            first += max((p[3] for p in pieces), default=-1) + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                tokens.append(words.encode(text.as_py()) + tail)
                size += len(tokens[-1]) // 4
                if len(ids) >= GROUP_DOCS or size >= GROUP_TOKENS:
                    yield from close()
                    ids, tokens, size = [], [], 0
                    give_back()
        if ids:
            yield from close()

    return spread.mapInArrow(rows, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
