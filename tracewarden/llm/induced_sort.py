"""Suffixes and common prefixes of a byte text by induced sorting, with queues that live on disk.

Only what the caller asks for is kept exact: order and common prefixes up to ``depth`` bytes.

* The suffixes that begin a rise after a fall (their left neighbour is larger) are sorted first: by their first
  bytes, then by pairs of ranks of twice as many following ones in each round.
* All other suffixes are induced from them in two sweeps over the alphabet.  A sweep takes tuples (position, common prefix with
  the one before) from a priority queue in suffix order and puts the suffix one byte earlier back under that byte.  What
  is put under one byte comes in the right order already, so the queue is a run of chunks per byte; chunks go to a
  temporary file once they exceed the memory budget.
* The common prefix of two induced suffixes is one more than the least value between their sources in the sweep; a small
  table of range minima answers that for a whole chunk at once.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

CHUNK = 1 << 18
SMALL = 12  # chunks up to this size are walked one by one
MEMORY = 24 << 20


class ChunkQueue:
    """Chunks of (position, common prefix) per byte; the oldest chunks are spilled when memory is full."""

    def __init__(self, memory: int = MEMORY):
        self.runs: list[deque] = [deque() for _ in range(257)]
        self.loose: list[list] = [[] for _ in range(257)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, byte: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self._settle(byte)
        self.runs[byte].append((positions, prefixes))
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.memory:
            self._spill()

    def put_one(self, byte: int, position: int, prefix: int) -> None:
        self.loose[byte].append((position, prefix))

    def _settle(self, byte: int) -> None:
        if self.loose[byte]:
            both = np.array(self.loose[byte], np.int64)
            self.loose[byte] = []
            self.runs[byte].append((both[:, 0].copy(), both[:, 1].astype(np.int16)))
            self.held += 10 * len(both)

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.runs:
            for i, chunk in enumerate(run):
                if isinstance(chunk[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(chunk[0].tobytes())
                    self.file.write(chunk[1].tobytes())
                    run[i] = (at, len(chunk[0]))
        self.held = 0

    def _load(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(chunk[0], np.ndarray):
            return chunk
        at, n = chunk
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.int16)

    def pop(self, byte: int):
        """The oldest tuples of a byte, about ``CHUNK`` of them at most, or None."""
        self._settle(byte)
        run = self.runs[byte]
        if not run:
            return None
        several, size = [], 0
        while run and size < CHUNK:
            if isinstance(run[0][0], np.ndarray):
                self.held -= run[0][0].nbytes + run[0][1].nbytes
            several.append(self._load(run.popleft()))
            size += len(several[-1][0])
        if len(several) == 1:
            return several[0]
        positions, prefixes = zip(*several)
        return np.concatenate(positions), np.concatenate(prefixes)

    def backwards(self, byte: int):
        """All chunks of a byte from the newest to the oldest."""
        self._settle(byte)
        while self.runs[byte]:
            chunk = self.runs[byte].pop()
            if isinstance(chunk[0], np.ndarray):
                self.held -= chunk[0].nbytes + chunk[1].nbytes
            yield self._load(chunk)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def common_prefix(text: np.ndarray, a: int, b: int, depth: int) -> int:
    x, y = text[a:a + depth], text[b:b + depth]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


class Sweep:
    """One pass of induction: takes suffixes in order and puts those one byte earlier under their byte."""

    def __init__(self, text: np.ndarray, queue: ChunkQueue, depth: int):
        self.text, self.queue, self.depth = text, queue, depth
        self.least = np.full(257, -1, np.int16)  # least prefix since the last tuple put under each byte; -1: none put yet

    def _one_by_one(self, positions: np.ndarray, prefixes: np.ndarray, induces) -> None:
        for position, prefix in zip(positions.tolist(), prefixes.tolist()):
            np.minimum(self.least, prefix, out=self.least)
            if position:
                byte = int(self.text[position - 1])
                if induces(byte):
                    self.queue.put_one(byte, position - 1, min(self.depth, int(self.least[byte]) + 1))
                    self.least[byte] = self.depth

    def take(self, positions: np.ndarray, prefixes: np.ndarray, induces) -> None:
        """``induces`` says of bytes whether a suffix that begins with one and goes on with a taken one belongs to this pass."""
        if len(positions) <= SMALL:
            return self._one_by_one(positions, prefixes, induces)
        for at in range(0, len(positions), CHUNK):
            self._chunk(positions[at:at + CHUNK], prefixes[at:at + CHUNK], induces)

    def _chunk(self, positions: np.ndarray, prefixes: np.ndarray, induces) -> None:
        before = self.text[np.maximum(positions, 1) - 1]
        chosen = np.flatnonzero(induces(before) & (positions > 0))
        all_least = prefixes.min()
        if not len(chosen):
            np.minimum(self.least, all_least, out=self.least)
            return
        byte = before[chosen]
        order = np.argsort(byte, kind="stable")
        chosen, byte = chosen[order], byte[order]
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(byte)) + 1])
        begins = np.empty(len(chosen), np.int64)
        begins[1:] = chosen[:-1] + 1
        begins[firsts] = 0
        table = [prefixes]
        longest = int((chosen - begins).max()) + 1
        while 2 << (len(table) - 1) <= longest:
            row, step = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(row[:-step], row[step:]))
        level = np.frexp((chosen - begins + 1).astype(np.float64))[1] - 1
        least = np.empty(len(chosen), np.int16)
        for k, row in enumerate(table):
            at = np.flatnonzero(level == k)
            if len(at):
                least[at] = np.minimum(row[begins[at]], row[chosen[at] - (1 << k) + 1])
        kinds = byte[firsts].astype(np.int64)
        least[firsts] = np.minimum(least[firsts], self.least[kinds])
        lasts = np.concatenate([firsts[1:], [len(chosen)]])
        rest = np.minimum.accumulate(prefixes[::-1])[::-1]
        carried = np.minimum(self.least, all_least)
        after = chosen[lasts - 1] + 1
        carried[kinds] = np.where(after < len(prefixes), rest[np.minimum(after, len(prefixes) - 1)], self.depth)
        self.least = carried
        values = np.minimum(least + np.int16(1), self.depth).astype(np.int16)
        earlier = positions[chosen] - 1
        for kind, lo, hi in zip(kinds.tolist(), firsts.tolist(), lasts.tolist()):
            self.queue.put(kind, earlier[lo:hi].copy(), values[lo:hi].copy())


def turning_points(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose suffix rises after a fall, and how many equal bytes begin there.  The last byte must be the least."""
    heads = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])  # beginnings of runs of equal bytes
    values = text[heads].astype(np.int16)
    rises = np.empty(len(heads), bool)
    rises[:-1] = values[:-1] < values[1:]
    rises[-1] = True
    turns = np.flatnonzero(rises[1:] & (values[:-1] > values[1:])) + 1
    lengths = np.diff(np.concatenate([heads, [len(text)]]))
    return heads[turns], lengths[turns]


def _words(text: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one big-endian number; the text has eight bytes to spare."""
    out = np.zeros(len(positions), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | text[positions + i]
    return out


def _ranks(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return ranks


def sort_turning_points(text: np.ndarray, padded: np.ndarray, points: np.ndarray, runs: np.ndarray, depth: int) -> np.ndarray:
    """Order of the turning points by their next ``depth`` bytes; ties in any order.

    A rank stands for the same number of bytes in all that share it, since equal bytes have equal turning points as long
    as the next turn lies inside them; where it does not, more bytes are compared first.
    """
    m = len(points)
    gap = np.empty(m, np.int64)
    gap[:-1] = np.diff(points) + runs[1:] + 1
    gap[-1] = len(text) - points[-1]
    one, two = _words(padded, points), _words(padded, points + 8)
    order = np.lexsort((two, one))
    fresh = np.ones(m, bool)
    fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    ranks = _ranks(order, fresh)
    del one, two
    seen = 16
    while seen < depth:  # groups in which the next turn may lie beyond the bytes seen
        tied = ~fresh | np.concatenate([~fresh[1:], [False]])
        wide = np.zeros(m, bool)
        wide[ranks[order[tied & (gap[order] > seen)]]] = True
        places = np.flatnonzero(tied & wide[ranks[order]])
        if not len(places):
            break
        who = order[places]
        more = _words(padded, np.minimum(points[who] + seen, len(text)))
        by = np.lexsort((more, ranks[who]))
        order[places] = who[by]
        fresh[places[1:]] |= (more[by][1:] != more[by][:-1])
        ranks = _ranks(order, fresh)
        seen += 8
    step = 1
    while True:
        tied = ~fresh | np.concatenate([~fresh[1:], [False]])
        places = np.flatnonzero(tied)
        who = order[places]
        reach = np.minimum(who + step, m - 1)
        open_ = (who + step < m) & (points[reach] - points[who] < depth)
        group_open = np.zeros(m, bool)
        group_open[ranks[who[open_]]] = True
        keep = group_open[ranks[who]]
        places, who, reach = places[keep], who[keep], reach[keep]
        if not len(places):
            return order
        own, following = ranks[who], np.where(open_[keep], ranks[reach], 0)
        by = np.argsort(own * np.int64(m + 1) + following, kind="stable")
        order[places] = who[by]
        same_place = np.diff(places) == 1
        changed = (following[by][1:] != following[by][:-1]) & (own[by][1:] == own[by][:-1]) & same_place
        fresh[places[1:]] |= changed
        ranks = _ranks(order, fresh)
        step *= 2


def neighbour_prefixes(padded: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each position with the one before it, up to ``depth``; 0 for the first."""
    out = np.zeros(len(positions), np.int16)
    left, right, seen = positions[:-1], positions[1:], 0
    active = np.arange(1, len(positions))
    limit = len(padded) - 8
    while len(active) and seen < depth:
        x = _words(padded, np.minimum(left + seen, limit)) ^ _words(padded, np.minimum(right + seen, limit))
        some = x != 0
        zeros = 64 - np.frexp(x.astype(np.float64))[1]  # rounding up at worst hides the last of the equal bytes
        exact = np.zeros(len(x), np.int64)
        exact[some] = np.clip(zeros[some], 0, 63) // 8
        out[active[some]] = np.minimum(seen + exact[some], depth)
        out[active[~some]] = min(seen + 8, depth)
        left, right, active = left[~some], right[~some], active[~some]
        seen += 8
    return out


def repeated_starts(pieces: list[bytes], depth: int, memory: int = MEMORY) -> np.ndarray:
    """One flag per byte of the pieces laid end to end with one byte between: a string of ``depth`` bytes that starts
    here, inside its piece, also starts somewhere else.
    """
    size = sum(map(len, pieces)) + len(pieces) + 1
    padded = np.zeros(size + 24, np.uint8)
    raw = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    # bytes move up by two, separators become 1, the end is 0; UTF-8 never holds the bytes that have no room
    padded[:size - 1] = raw + np.uint8(2)
    text = padded[:size]
    flags = np.zeros(size, bool)
    points, runs = turning_points(text)
    order = sort_turning_points(text, padded, points, runs, depth)
    sorted_points = points[order]
    del order, runs, points
    point_prefixes = neighbour_prefixes(padded, sorted_points, depth)
    first_bytes = text[sorted_points]
    edges = np.searchsorted(first_bytes, np.arange(258))
    falling, rising = ChunkQueue(memory), ChunkQueue(memory)
    kept = ChunkQueue(memory)
    alphabet = np.flatnonzero(np.bincount(text, minlength=257)).tolist()

    def mark(positions: np.ndarray, prefixes: np.ndarray, before: int | None) -> int:
        hit = np.flatnonzero(prefixes >= depth)
        flags[positions[hit]] = True
        flags[positions[hit[hit > 0] - 1]] = True
        if before is not None and len(hit) and hit[0] == 0:
            flags[before] = True
        return int(positions[-1])

    sweep, last_falling = Sweep(text, falling, depth), {}
    for c in alphabet:
        last = None
        while (chunk := falling.pop(c)) is not None:
            positions, prefixes = chunk
            last = mark(positions, prefixes, last)
            sweep.take(positions, prefixes, lambda b, c=c: b >= c)
            kept.put(c, positions, prefixes)
        lo, hi = int(edges[c]), int(edges[c + 1])
        if hi > lo:
            prefixes = point_prefixes[lo:hi].copy()
            prefixes[0] = 0 if last is None else common_prefix(text, last, int(sorted_points[lo]), depth)
            sweep.take(sorted_points[lo:hi], prefixes, lambda b, c=c: b > c)
        last_falling[c] = last
    falling.close()
    del sorted_points, point_prefixes

    sweep = Sweep(text, rising, depth)
    for c in reversed(alphabet):
        last = None
        while (chunk := rising.pop(c)) is not None:
            positions, prefixes = chunk
            last = mark(positions, prefixes, last)
            sweep.take(positions, prefixes, lambda b, c=c: b <= c)
        # the falling suffixes of this byte lie before its rising ones
        gap = 0 if last is None or last_falling[c] is None else common_prefix(text, last, last_falling[c], depth)
        if gap >= depth:
            flags[last] = flags[last_falling[c]] = True
        for positions, prefixes in kept.backwards(c):
            turned = np.concatenate([[gap], prefixes[:0:-1]]).astype(np.int16)
            sweep.take(positions[::-1], turned, lambda b, c=c: b < c)
            gap = int(prefixes[0])
    rising.close()
    kept.close()
    return flags
