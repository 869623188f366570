"""Documents packed into as few sequences as possible: large pieces are matched in pairs, small ones best-fit the gaps.

A document longer than a sequence is cut into full sequences and a rest.  Of pieces above one third of a sequence at most
two fit together: from the longest down, each is matched with the longest one left that fits beside it.  The smaller pieces,
from the longest down, go into the smallest gap that holds them, and into new sequences where there is none.

The plan does not need the pieces, only how many there are of each length, and a sequence has few lengths.  So the
whole table is one packing problem, not one for each task: the counts by length (at most ``length`` rows) are collected, runs of equal
sequences are planned at once, and every piece finds its place by its rank among the pieces of its length.  Ranks are a
place within a task plus the sums of the tasks before it; no length, however common, is ranked in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import store
from tracewarden.llm.word_bpe import encoder
from tracewarden.session import spread

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, doc_tokens long, part int, place long"


class Run(NamedTuple):
    """Pieces of one length: rank ``first`` goes to ``sequence`` at ``offset``, ``each`` of them to a sequence."""

    length: int
    first: int
    sequence: int
    offset: int
    each: int


class Gaps:
    """Runs of sequences with the same free space, smallest space first."""

    def __init__(self):
        self.spaces: list[int] = []
        self.runs: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, space: int, sequence: int, count: int, used: int) -> None:
        if space and count:
            if space not in self.runs:
                bisect.insort(self.spaces, space)
                self.runs[space] = []
            self.runs[space].append((sequence, count, used))

    def best(self, length: int) -> tuple[int, int, int, int] | None:
        """Take out a run with the smallest space that holds ``length``: ``(space, sequence, count, used)``."""
        at = bisect.bisect_left(self.spaces, length)
        if at == len(self.spaces):
            return None
        space = self.spaces[at]
        run = self.runs[space].pop()
        if not self.runs[space]:
            del self.runs[space], self.spaces[at]
        return (space, *run)


def match_large(counts: dict[int, int], capacity: int, gaps: Gaps) -> tuple[list[Run], int]:
    """Pairs of pieces above a third of ``capacity``, longest first; gives their runs and the number of sequences."""
    left, placed, runs, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts)

    def put(length: int, count: int, offset: int) -> None:
        runs.append(Run(length, placed[length], sequence, offset, 1))
        placed[length] += count
        left[length] -= count

    partners = [n for n in lengths if n < capacity]
    for longest in reversed(lengths):
        while left[longest]:
            while partners and not left[partners[-1]]:
                partners.pop()
            at = bisect.bisect_right(partners, capacity - longest) - 1
            while at >= 0 and (not left[partners[at]] or (partners[at] == longest and left[longest] < 2)):
                at -= 1
            if at < 0:
                n, used = left[longest], longest
                put(longest, n, 0)
            elif partners[at] == longest:
                n, used = left[longest] // 2, 2 * longest
                first = placed[longest]
                runs.append(Run(longest, first, sequence, 0, 2))
                placed[longest] += 2 * n
                left[longest] -= 2 * n
            else:
                partner = partners[at]
                n, used = min(left[longest], left[partner]), longest + partner
                put(longest, n, 0)
                put(partner, n, longest)
            gaps.add(capacity - used, sequence, n, used)
            sequence += n
    return runs, sequence


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every piece of ``counts`` (length to number), and the number of sequences."""
    gaps = Gaps()
    runs, sequences = match_large({n: c for n, c in counts.items() if 3 * n > capacity and c}, capacity, gaps)
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        first, left = 0, counts[length]
        while left:
            space, sequence, count, used = gaps.best(length) or (capacity, sequences, -(-left // (capacity // length)), 0)
            if not used:
                sequences += count
            each = space // length
            full = min(count, left // each)  # a best fit fills one sequence before it opens the next
            if full:
                runs.append(Run(length, first, sequence, used, each))
                gaps.add(space - each * length, sequence, full, used + each * length)
                first, left = first + full * each, left - full * each
            if full < count:
                if left:  # the last of this length
                    runs.append(Run(length, first, sequence + full, used, each))
                    gaps.add(space - left * length, sequence + full, 1, used + left * length)
                    first, full, left = first + left, full + 1, 0
                gaps.add(space, sequence + full, count - full, used)
    return runs, sequences


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, length: int) -> DataFrame:
    """Stored pieces of ``PIECE_SCHEMA``; ``part`` and ``place`` number the pieces of one length within a task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail, part = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        columns: list[list] = [[] for _ in range(7)]
        held = 0

        def close() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.record_batch(
                [*arrays, pa.array([part] * len(columns[0]), pa.int32()), pa.array(columns[6], pa.int64())], [f.split()[0] for f in PIECE_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words.encode(text.as_py()) + tail
                total = len(tokens) // 4
                for number, start in enumerate(range(0, total, length)):
                    own = min(length, total - start)
                    for column, value in zip(columns, (doc_id, number, start, own, tokens[4 * start:4 * (start + own)], total, int(seen[own]))):
                        column.append(value)
                    seen[own] += 1
                    held += own
                    if held > 1 << 20:
                        yield close()
                        columns, held = [[] for _ in range(7)], 0
        if columns[0]:
            yield close()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(spread(picked).mapInArrow(rows, PIECE_SCHEMA))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset``.

    ``docs``: doc_id, text; other columns are left out.  A null text is a document of the end id alone; rows that repeat a doc_id, or
    hold a null one, are packed each on its own; an empty table gives no pieces.  Sequences are numbered from 0 without gaps.
    The pieces stay in the shared folder, since the result is read from them.
    """
    pieces = cut(docs, tokenizer_path, end_id, length)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    totals = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    runs, _ = plan(totals, length)
    runs.sort()
    starts = np.array([(r.length, r.first) for r in runs], np.int64).reshape(-1, 2)
    first_run = np.searchsorted(starts[:, 0], np.arange(length + 2))
    sequence, offset, each = (np.array([getattr(r, name) for r in runs], np.int64) for name in ("sequence", "offset", "each"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length_, rank = lengths.to_numpy(), ranks.to_numpy()
        at = np.zeros(len(rank), np.int64)
        for n in np.unique(length_):
            own = length_ == n
            at[own] = first_run[n] + np.searchsorted(starts[first_run[n]:first_run[n + 1], 1], rank[own], side="right") - 1
        step = rank - starts[at, 1]
        return pd.DataFrame({"sequence_id": sequence[at] + step // each[at], "offset": offset[at] + step % each[at] * length_})

    # only lengths and ranks go through Python; the ids stay where they are
    placed = pieces.join(bases.select("part", "length", "base"), ["part", "length"]).withColumn("_at", place("length", F.col("base") + F.col("place")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "doc_tokens", "_at.sequence_id", "_at.offset")
