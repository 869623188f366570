"""Nearest neighbours by largest inner product from an inverted multi-index.

The two halves of a vector are quantised apart, which gives ``centroids ** 2`` cells.  A query walks the pairs of centroids in
falling order of their summed inner products, taken from a heap, until the cells on its way hold the wanted share of the vectors;
and at least k + 1 ids; all rows in them are scored exactly.  Copies count once towards the share, and a cell as ``HOT_CELL`` times the mean one at most, so
that equal or nearly equal vectors do not use it up: their rows come on top.  The cells of one left centroid lie together, so that a query travels once to each left
centroid it visits, with the right ones it wants.  Each left centroid's rows are dealt into blocks of bounded size; queries
stream past a block.

Vectors that are null, zero, hold null or non-finite components, or have another dimension than most, take no part.
Rows that repeat a vec_id count once among the neighbours, and never as neighbours of that id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import discard, materialize

CENTROIDS, SAMPLE_ROWS, ROUNDS = 32, 20_000, 12
BLOCK_ROWS, SHARE, HOT_CELL = 4096, 0.6, 4


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` in double precision, without the rows that take no part."""
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return vectors.where(F.size("vector") == (sizes.d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def cluster(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd rounds on the sample; an emptied centroid moves to the point farthest from its own.

    The first ones are drawn with chances of squared distance, so that a dense spot does not take many of them.
    """
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    chosen = [int(rng.integers(len(distinct)))]
    far = ((distinct - distinct[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and far.any():
        chosen.append(int(rng.choice(len(distinct), p=far / far.sum())))
        far = np.minimum(far, ((distinct - distinct[chosen[-1]]) ** 2).sum(1))
    centers = distinct[chosen].copy()
    for _ in range(ROUNDS):
        away = (points ** 2).sum(1)[:, None] - 2 * points @ centers.T + (centers ** 2).sum(1)
        nearest = away.argmin(1)
        counts = np.bincount(nearest, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        for empty in np.flatnonzero(counts == 0):
            far = away[np.arange(len(points)), nearest].argmax()
            centers[empty] = points[far]
            away[far] = 0
    return centers


def assign(vectors: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    half = first.shape[1]
    i = ((first ** 2).sum(1) - 2 * vectors[:, :half] @ first.T).argmin(1)
    j = ((second ** 2).sum(1) - 2 * vectors[:, half:] @ second.T).argmin(1)
    return i * len(second) + j


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int, owned: np.ndarray | None = None, least: int = 0) -> list[int]:
    """Cells in falling order of ``left[i] + right[j]`` until they hold ``wanted`` of ``sizes`` and ``least`` of ``owned``; empty ones are passed over."""
    by_left, by_right = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, seen, cells, held, own = [(-(left[by_left[0]] + right[by_right[0]]), 0, 0)], {(0, 0)}, [], 0, 0
    while heap and (held < wanted or own < least):
        _, a, b = heapq.heappop(heap)
        cell = int(by_left[a]) * len(right) + int(by_right[b])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
            own += 0 if owned is None else int(owned[cell])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(left) and y < len(right) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(left[by_left[x]] + right[by_right[y]]), x, y))
    return cells


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products added up in one fixed order, so equal vectors score equally wherever they are."""
    return np.ascontiguousarray(vectors * query).sum(axis=1)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, wanted: np.ndarray, vectors: np.ndarray, ids: np.ndarray, cells: np.ndarray, k: int):
    """For each query its k best among the block's rows in the cells it wants: ``(query ids, ids, scores)``.

    ``wanted``: one row of flags per query, one column per right centroid; ``cells``: the rows' right centroids.  Equal
    vectors are scored once.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors, cells = ids[order], np.ascontiguousarray(vectors[order]), cells[order]
    distinct, at, where = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    by_vector = np.argsort(where.ravel(), kind="stable")  # ids rise within a vector
    starts = np.concatenate([[0], np.cumsum(np.bincount(where.ravel(), minlength=len(distinct)))])
    allowed = wanted[:, cells[at]]
    rough = np.where(allowed, queries @ distinct.T, -np.inf)
    slack = 1e-9 * (np.abs(queries).max(1) * np.abs(distinct).max() * distinct.shape[1])
    take = min(k + 1, len(distinct))
    floor = np.partition(rough, len(distinct) - take, axis=1)[:, len(distinct) - take] - slack
    out_q, out_i, out_s = [], [], []
    for q in range(len(queries)):
        near = np.flatnonzero((rough[q] >= floor[q]) & allowed[q])
        if not len(near):
            continue
        scores = exact_scores(queries[q], distinct[near])
        members = [ids[by_vector[starts[d]:min(starts[d + 1], starts[d] + k + 1)]] for d in near]
        found, value = np.concatenate(members), np.repeat(scores, [len(m) for m in members])
        other = found != query_ids[q]
        found, value = found[other], value[other]
        best = np.lexsort((found, -value))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_i.append(found[best])
        out_s.append(value[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def search(
    rows: DataFrame, every: int = 20, k: int = 20, centroids: int = CENTROIDS, share: float = SHARE, block_rows: int = BLOCK_ROWS, seed: int = 42,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row whose vec_id is divisible by ``every``.

    ``share``: part of the different vectors that a query scores, dense cells counted as ``HOT_CELL`` mean ones.  A table without usable vectors gives no rows.
    """
    vectors = usable(rows)
    total = vectors.select(F.xxhash64("vector")).distinct().count()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = min(1.0, 1.2 * SAMPLE_ROWS / total)
    unit = F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = np.array([r.vector for r in vectors.where(unit < part).select("vector").distinct().limit(SAMPLE_ROWS).toLocalIterator()], np.float64)
    if not len(sample):
        sample = np.array([vectors.first().vector], np.float64)
    half = max(1, sample.shape[1] // 2)
    first, second = cluster(sample[:, :half], centroids, seed), cluster(sample[:, half:], centroids, seed + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = assign(_matrix(batch.column(1)), first, second)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32))], ["vec_id", "vector", "cell"])

    columns = len(second)
    placed = materialize(vectors.mapInArrow(place, "vec_id long, vector array<double>, cell int"))
    sizes = np.zeros(len(first) * columns, np.int64)
    budget = np.zeros(len(sizes), np.int64)
    by_vector = placed.groupBy("cell", F.xxhash64("vector").alias("v")).count()
    for r in by_vector.groupBy("cell").agg(F.sum("count").alias("n"), F.count("*").alias("different")).collect():  # centroids squared at most
        sizes[r.cell], budget[r.cell] = r.n, r.different
    budget = np.minimum(budget, int(np.ceil(HOT_CELL * budget.sum() / np.count_nonzero(budget))))
    owned = np.zeros(len(sizes), np.int64)  # different ids, each in one cell: a walk over k + 1 of them meets k others
    for r in placed.groupBy("vec_id").agg(F.min("cell").alias("cell")).groupBy("cell").count().collect():
        owned[r["cell"]] = r["count"]
    blocks = np.maximum(1, -(-sizes.reshape(-1, columns).sum(1) // block_rows))
    wanted = int(np.ceil(share * budget.sum()))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = _matrix(batch.column(1))
            for at in range(0, len(queries), 256):
                part = queries[at:at + 256]
                left, right = part[:, :half] @ first.T, part[:, half:] @ second.T
                which, rows_, block, cells = [], [], [], []
                for q in range(len(part)):
                    visited: dict[int, list[int]] = {}
                    for cell in walk(left[q], right[q], budget, wanted, owned, k + 1):
                        visited.setdefault(cell // columns, []).append(cell % columns)
                    for row, own in visited.items():
                        for b in range(blocks[row]):
                            which.append(at + q)
                            rows_.append(row)
                            block.append(b)
                            cells.append(own)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(rows_, pa.int32()), pa.array(block, pa.int32()),
                     pa.array(np.ones(len(which), np.int32)), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "vector", "row", "block", "asks", "cells"])

    asked = placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "vector")
    visits = asked.mapInArrow(visit, "vec_id long, vector array<double>, row int, block int, asks int, cells array<int>")
    deal = F.broadcast(rows.sparkSession.createDataFrame(
        [(c, int(b)) for c, b in enumerate(blocks)], "row int, blocks int"))  # one row per left centroid
    entries = placed.withColumn("row", F.floor(F.col("cell") / columns).cast("int")).join(deal, "row").select(
        "vec_id", "vector", "row", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"),
        F.array((F.col("cell") % columns).cast("int")).alias("cells"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, block, asks = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]])):
                own_ids, own = batch.column(3).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(4).slice(lo, hi - lo))
                own_cells = batch.column(5).slice(lo, hi - lo)
                if (row[lo], block[lo]) != at:
                    at, parts, held = (row[lo], block[lo]), [], None
                if not asks[lo]:
                    parts.append((own, own_ids, own_cells.flatten().to_numpy()))
                elif parts:
                    held = held or tuple(np.concatenate(c) for c in zip(*parts))
                    flags = np.zeros((len(own), columns), bool)
                    lists = own_cells.to_pylist()
                    flags[np.repeat(np.arange(len(own)), [len(c) for c in lists]), np.concatenate(lists)] = True
                    for s in range(0, len(own), 512):
                        found_ = best_of_block(own[s:s + 512], own_ids[s:s + 512], flags[s:s + 512], *held, k)
                        yield pa.record_batch([pa.array(c) for c in found_], ["query_id", "vec_id", "score"])

    together = entries.unionByName(visits).select("row", "block", "asks", "vec_id", "vector", "cells")
    found = together.repartition("row", "block").sortWithinPartitions("row", "block", "asks").mapInArrow(
        score, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = materialize(once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k))
    discard(placed)
    return best
