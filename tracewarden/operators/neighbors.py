"""Exact k-nearest-neighbour join on blocks.

Queries and corpus rows meet in bounded blocks; a block returns the k best per query, never its
pairs, and a rank-limited window merges the blocks.  Above one block of corpus rows the work is
pruned as in the pivot-based kNN joins of the literature (Lu et al., VLDB 2012): each query
belongs to the cell of its nearest pivot, and a corpus row travels to a cell only if the triangle
inequality allows it to be among the k nearest of some query there.

A few queries of checked size are sent to the corpus instead: every task keeps the k best of its rows for each of them, so that
the corpus is read once and neither shuffled nor sorted.

Copies of one vector can be most of the corpus.  No more than the k+1 smallest ids of a copy group
can be anyone's neighbours, so the corpus is cut to those by a rank limit that runs before its
shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import materialize

BLOCK_ROWS = 8192
MAX_PIVOTS = 512
MAX_BLOCKS = 16  # blocks of a table whose rows fit them; a row travels to each block of the other side it may matter to
BLOCK_BYTES = 32 << 20  # vectors of a block, which a task holds; beyond MAX_BLOCKS of these there are more blocks
SLICE_ROWS, SENT_BYTES = 2048, 4 << 20  # rows looked at and vectors sent on at once by a task
QUERY_SLICE, CORPUS_SLICE = 256, 2048  # pairs of a block compared at once: their bounds fit the processor cache
SLACK = 1e-10  # of the squared lengths; far above what a product of vectors rounds
BROADCAST_BYTES = 64 << 20  # a corpus of one block and no more than this goes to every task
FEW_QUERIES, FEW_BYTES = 1024, 16 << 20  # so few queries go to every task, and the corpus stays where it is
EDGE_SCHEMA = "query_id long, neighbor_id long, rank int, distance double"


def _stack(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()) if len(series) else np.empty((0, 0))


def _sum_left_to_right(parts: np.ndarray) -> np.ndarray:
    """Row sums in entry order, the order a SQL fold uses."""
    total = np.zeros(len(parts))
    for j in range(parts.shape[1]):
        total = total + parts[:, j]
    return total


def exact_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``."""
    if metric == "l2":
        return np.sqrt(_sum_left_to_right((a - b) ** 2))
    dot = _sum_left_to_right(a * b)
    norms = np.sqrt(_sum_left_to_right(a * a)) * np.sqrt(_sum_left_to_right(b * b))
    return 1.0 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def _bounds_as_product(m: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Rows whose products with those of the other side are lower bounds of (squared) distances, a little below them."""
    if metric == "l2":
        square = np.einsum("ij,ij->i", m, m) * (1 - SLACK)
        return np.column_stack([m * -2.0, square, np.ones(len(m))] if side == 0 else [m, np.ones(len(m)), square])
    # a zero vector stays zero: its product is 0 and its distance 1, as the exact one
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(norm > 0, norm, 1.0)
    return np.column_stack([-unit, np.full(len(m), 1 - SLACK)] if side == 0 else [unit, np.ones(len(m))])


def _lowest(qi: np.ndarray, upper: np.ndarray, take: int, limit: np.ndarray) -> None:
    """Lower each query's limit to the ``take``-th of its upper bounds, if it has so many; ``qi`` rises."""
    order = np.lexsort((upper, qi))
    starts = np.searchsorted(qi, np.arange(len(limit) + 1))
    full = np.flatnonzero(np.diff(starts) >= take)
    limit[full] = np.minimum(limit[full], upper[order][starts[full] + take - 1])


def _candidates(q: np.ndarray, corpus: np.ndarray, q_size: np.ndarray, c_size: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, corpus row) of all pairs that can be among a query's ``take`` nearest, by query.

    The corpus comes in slices: once a slice has given each query a limit, the others are only compared with it.
    """
    limit = np.full(len(q), np.inf)
    qi, ci, low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    step = max(CORPUS_SLICE, take)
    for start in range(0, len(corpus), step):
        lower = q @ corpus[start:start + step].T
        if not start and lower.shape[1] > take:
            # each pair has its own rounding error, so one row of huge norm does not make all others candidates
            upper = lower + 2 * SLACK * (q_size[:, None] + c_size[None, :lower.shape[1]])
            limit = np.partition(upper, take - 1, axis=1)[:, take - 1]
        spot = np.flatnonzero(lower <= limit[:, None])
        if not len(spot):
            continue
        new_q, new_c = np.divmod(spot, lower.shape[1])
        qi, ci, low = np.concatenate([qi, new_q]), np.concatenate([ci, new_c + start]), np.concatenate([low, lower.ravel()[spot]])
        order = np.argsort(qi, kind="stable")
        qi, ci, low = qi[order], ci[order], low[order]
        _lowest(qi, low + 2 * SLACK * (q_size[qi] + c_size[ci]), take, limit)
        keep = low <= limit[qi]
        qi, ci, low = qi[keep], ci[keep], low[keep]
    return qi, ci


def block_top_k(q_ids, q_vecs, c_ids, c_vecs, k: int, metric: str, exclude_self: bool) -> pd.DataFrame:
    """k nearest corpus rows of each query in one block.

    A matrix product finds the candidates with a little slack; distances and order of the
    candidates are then computed exactly.
    """
    qa, ca = _bounds_as_product(q_vecs, metric, 0), _bounds_as_product(c_vecs, metric, 1)
    if metric == "l2":
        q_size, c_size = np.einsum("ij,ij->i", q_vecs, q_vecs), np.einsum("ij,ij->i", c_vecs, c_vecs)
    else:
        q_size, c_size = np.full(len(qa), 0.5), np.full(len(ca), 0.5)
    take = min(k + (1 if exclude_self else 0), len(c_ids))
    parts = []
    for start in range(0, len(q_ids), QUERY_SLICE):
        own = slice(start, start + QUERY_SLICE)
        qi, ci = _candidates(qa[own], ca, q_size[own], c_size, take)
        ids_q, ids_c = q_ids[own][qi], c_ids[ci]
        if exclude_self:
            other = ids_q != ids_c
            qi, ci, ids_q, ids_c = qi[other], ci[other], ids_q[other], ids_c[other]
        dist = exact_distances(q_vecs[own][qi], c_vecs[ci], metric)
        order = np.lexsort((ids_c, dist, qi))
        qi, ids_q, ids_c, dist = qi[order], ids_q[order], ids_c[order], dist[order]
        firsts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1] if len(qi) else np.array([], dtype=int)
        place = np.arange(len(qi)) - np.repeat(firsts, np.diff(np.r_[firsts, len(qi)]))
        keep = place < k
        parts.append(pd.DataFrame({
            "query_id": ids_q[keep], "neighbor_id": ids_c[keep], "rank": place[keep] + 1, "distance": dist[keep],
        }))
    return pd.concat(parts) if parts else _no_edges()


def _no_edges() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "neighbor_id": [], "rank": [], "distance": []})


def _block_function(k: int, metric: str, exclude_self: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _no_edges()
        if len(left) and len(right):
            sides = [(side.column("id").to_numpy(), _matrix(side.column("v").combine_chunks())) for side in (left, right)]
            found = block_top_k(*sides[0], *sides[1], k, metric, exclude_self)
        types = {"query_id": pa.int64(), "neighbor_id": pa.int64(), "rank": pa.int32(), "distance": pa.float64()}
        return pa.table({name: pa.array(found[name].to_numpy().astype(t.to_pandas_dtype()), t) for name, t in types.items()})
    return run


def limit_copies(corpus: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` smallest ids of every group of identical vectors."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return corpus.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as one matrix, without an object for each row."""
    if not len(column):
        return np.empty((0, 0))
    widths = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or widths["min"] != widths["max"]:
        raise ValueError("vectors of one size are needed")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), widths["min"])


def _slices(batches):
    """Arrow batches in pieces of ``SLICE_ROWS``, so that a task's tables of rows by cells stay small."""
    for batch in batches:
        for start in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _points(column: pa.Array, metric: str) -> np.ndarray:
    """Where vectors lie for the bounds: on unit vectors the Euclidean order is the cosine order."""
    m = _matrix(column)
    if metric == "l2":
        return m
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def _pivot_pass(pivots, k: int, want: str, metric: str):
    """One pass over vectors against the pivots: cell radii of queries, or k-th corpus distances."""
    def run(batches):
        p = pivots.value
        radius, count = np.full(len(p), -1.0), np.zeros(len(p), dtype=np.int64)
        near = np.full((len(p), k), np.inf)
        seen = False
        for batch in _slices(batches):
            seen = True
            d = _to_pivots(_points(batch.column("v"), metric), p)
            if want == "cells":
                cell = d.argmin(axis=1)
                np.maximum.at(radius, cell, d[np.arange(len(d)), cell])
                np.add.at(count, cell, 1)
            else:
                both = np.concatenate([near, d.T], axis=1)
                near = np.partition(both, k - 1, axis=1)[:, :k]
        if seen and want == "cells":
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cell": hit.astype(np.int32), "radius": radius[hit], "n": count[hit]})
        elif seen:
            yield pa.RecordBatch.from_pydict({"cell": np.repeat(np.arange(len(p), dtype=np.int32), k), "d": near.ravel()})
    return run


def _to_pivots(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", m, m)[:, None] + np.einsum("ij,ij->i", p, p)[None, :] - 2.0 * (m @ p.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _assign_cells(pivots, metric: str):
    def run(batches):
        for batch in _slices(batches):
            cell = _to_pivots(_points(batch.column("v"), metric), pivots.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])
    return run


def _send(pivots, reach, metric: str, count_only: bool):
    """Cells a corpus row may matter to: all whose reach covers its distance to their pivot.

    A row can go to every cell, so what leaves is cut into batches of bounded size.
    """
    def run(batches):
        totals = np.zeros(len(reach.value), dtype=np.int64)
        for batch in _slices(batches):
            points = _points(batch.column("v"), metric)
            ok = _to_pivots(points, pivots.value) <= reach.value[None, :]
            if count_only:
                totals += ok.sum(axis=0)
                continue
            ri, ci = np.nonzero(ok)
            step = max(1, SENT_BYTES // (8 * max(1, points.shape[1])))
            for start in range(0, len(ri), step):
                out = batch.take(pa.array(ri[start:start + step]))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ci[start:start + step].astype(np.int32))], [*out.schema.names, "cell"])
        if count_only:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(totals), dtype=np.int32), "n": totals})
    return run


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", vec_col: str = "embedding",
    id_col: str = "row_id", exclude_self: bool = True, block_rows: int = BLOCK_ROWS, few_queries: int = FEW_QUERIES,
) -> DataFrame:
    """V4: ``(query_id, neighbor_id, rank, distance)`` for the k nearest corpus rows of every query.

    Ties break by neighbour id.  ``exclude_self`` skips a corpus row with the query's own id.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    c = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    size = c.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    if size["n"] <= block_rows and size["n"] * size["d"] * 8 <= BROADCAST_BYTES:
        return _edges_to_broadcast(q, limit_copies(c, k + 1), k, metric, exclude_self)
    few = q.limit(few_queries + 1).count()
    if few <= few_queries and few * size["d"] * 8 <= FEW_BYTES:
        edges = edges_from_corpus(q, c, k, metric, exclude_self)
    else:
        c = materialize(limit_copies(c, k + 1))
        edges = _blocked_edges(q, c, c.count(), size["d"], k, metric, exclude_self, block_rows)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return edges.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "distance")


def _edges_to_broadcast(q: DataFrame, c: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """A corpus of checked size is sent to every task; queries stay where they are, nothing is shuffled."""
    rows = c.toPandas()
    state = q.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), _stack(rows["v"])))

    def run(batches):
        ids, corpus = state.value
        for pdf in batches:
            if len(pdf) and len(ids):
                yield block_top_k(pdf["id"].to_numpy(), _stack(pdf["v"]), ids, corpus, k, metric, exclude_self)

    return q.mapInPandas(run, EDGE_SCHEMA)


def without_copies(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Rows that stay if only the ``keep`` smallest ids of equal vectors do."""
    turns = np.random.default_rng(0).integers(1, 1 << 63, vectors.shape[1], np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        mark = ((vectors + 0.0).view(np.uint64) * turns).sum(axis=1)
        mark ^= mark >> np.uint64(29)
    order = np.lexsort((ids, mark))
    place = np.arange(len(order))
    fresh = np.r_[True, (np.diff(mark[order]) != 0) | (vectors[order][1:] != vectors[order][:-1]).any(axis=1)] if len(order) else np.zeros(0, bool)
    return order[place - np.maximum.accumulate(np.where(fresh, place, 0)) < keep]


def edges_from_corpus(q: DataFrame, c: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """The k best of every task's corpus rows for each of a few queries (of checked size), ranked within the task."""
    rows = q.toPandas()
    state = q.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), _stack(rows["v"])))

    def run(batches):
        ids, queries = state.value
        best = _no_edges()
        for pdf in batches:
            if len(pdf) and len(ids):
                own, vectors = pdf["id"].to_numpy(), _stack(pdf["v"])
                kept = without_copies(own, vectors, k + 1)
                found = block_top_k(ids, queries, own[kept], vectors[kept], k, metric, exclude_self)
                best = pd.concat([best, found]) if len(best) else found
                best = best.sort_values(["query_id", "distance", "neighbor_id"])
                best = best[best.groupby("query_id").cumcount() < k]
        yield best

    return c.mapInPandas(run, EDGE_SCHEMA)


def _blocked_edges(q, c, n_corpus: int, width: int, k: int, metric: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """Candidate edges of pruned blocks; with cosine, zero vectors are handled apart, since no bound holds for them.

    A zero vector has distance 1 to every row: as a corpus row only the smallest ids of its kind can be neighbours, as a
    query its neighbours are the smallest ids of all.
    """
    if metric != "cosine":
        return _pruned_edges(q, c, n_corpus, width, k, metric, exclude_self, block_rows)
    zero = F.forall("v", lambda x: x == 0)
    need = k + (1 if exclude_self else 0)
    smallest = lambda df: [r["id"] for r in df.groupBy().agg(F.slice(F.sort_array(F.collect_list("id")), 1, need).alias("ids")).select(F.explode("ids").alias("id")).collect()]
    # the least ids of each id bucket first, so that what is gathered is bounded by the buckets
    least = lambda df: smallest(df.select("id", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")).alias("p")).where(F.col("p") <= need))

    def to_all(rows: DataFrame, ids: list[int]) -> DataFrame:
        pairs = rows.select(F.col("id").alias("query_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in ids]).cast("array<long>")).alias("neighbor_id"))
        return pairs.where("query_id != neighbor_id" if exclude_self else "true").select(
            "query_id", "neighbor_id", F.lit(0).alias("rank"), F.lit(1.0).alias("distance"))

    some_q, some_c = q.where(~zero), c.where(~zero)
    edges = to_all(q.where(zero), least(c)).unionByName(to_all(some_q, least(c.where(zero))))
    if not some_c.limit(1).count():
        return edges
    return edges.unionByName(_pruned_edges(some_q, some_c, n_corpus, width, k, metric, exclude_self, block_rows))


def _pivots_of(c: DataFrame, n_corpus: int, n_pivots: int, metric: str) -> np.ndarray:
    # a bounded number of rows, fixed by the hash of their id; only about twice that many are sorted
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    few = c.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1 << 20, max(64, (2 << 20) * n_pivots // max(1, n_corpus)))))
    chosen = few.orderBy(*order).limit(n_pivots).select("v").collect() or c.orderBy(*order).limit(n_pivots).select("v").collect()
    return np.unique(_points(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())), metric), axis=0)


def _reach(q, c, pivots, need: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every cell: the distance within which corpus rows matter to it, its queries, and those corpus rows' number."""
    m = len(pivots.value)
    cells = q.select("v").mapInArrow(_pivot_pass(pivots, need, "cells", metric), "cell int, radius double, n long").groupBy("cell").agg(
        F.max("radius").alias("radius"), F.sum("n").alias("n")
    ).toPandas()
    near = c.select("v").mapInArrow(_pivot_pass(pivots, need, "near", metric), "cell int, d double")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    kth = near.withColumn("_p", place).where(F.col("_p") == need).select("cell", "d").toPandas()
    reach = np.full(m, -1.0)
    q_count = np.zeros(m, dtype=np.int64)
    kth_of = dict(zip(kth["cell"], kth["d"]))
    for row in cells.itertuples():
        # any query here is within `radius` of the pivot, so its k-th neighbour is within radius + kth
        bound = 2.0 * row.radius + kth_of.get(row.cell, np.inf)
        reach[row.cell] = bound * (1 + 1e-9) + 1e-9
        q_count[row.cell] = row.n
    limits = q.sparkSession.sparkContext.broadcast(reach)
    sent = c.select("v").mapInArrow(_send(pivots, limits, metric, True), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    c_count = np.zeros(m, dtype=np.int64)
    c_count[sent["cell"].to_numpy(dtype=int)] = sent["n"].to_numpy()
    return reach, q_count, c_count


def block_size(rows: int, width: int, block_rows: int, blocks: int) -> int:
    """Rows of a block: ``block_rows``, more of them where a table would fall into more than ``blocks``, never above ``BLOCK_BYTES``."""
    return min(max(block_rows, -(-rows // blocks)), max(1, BLOCK_BYTES // (8 * max(1, width))))


def _pruned_edges(q, c, n_corpus: int, width: int, k: int, metric: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """Small cells if the bounds keep most rows out of most of them; else few large ones, since a row travels to every cell it may matter to."""
    sc = q.sparkSession.sparkContext
    need = k + (1 if exclude_self else 0)
    for wanted in (int(min(MAX_PIVOTS, max(2, 2 * n_corpus // block_rows))), MAX_BLOCKS):
        pivots = sc.broadcast(_pivots_of(c, n_corpus, wanted, metric))
        reach, q_count, c_count = _reach(q, c, pivots, need, metric)
        q_parts = np.maximum(1, -(-q_count // block_size(int(q_count.sum()), width, block_rows, MAX_BLOCKS))).astype(int)
        if wanted <= MAX_BLOCKS or (c_count * q_parts).sum() <= 2 * MAX_BLOCKS * n_corpus:
            break
    c_parts = np.maximum(1, -(-c_count // block_size(n_corpus, width, block_rows, MAX_BLOCKS // 2))).astype(int)
    limits = sc.broadcast(reach)
    q_lit = F.array(*[F.lit(int(x)) for x in q_parts])
    c_lit = F.array(*[F.lit(int(x)) for x in c_parts])
    part_of = lambda sizes: F.pmod(F.xxhash64("id"), F.get(sizes, F.col("cell"))).cast("int")
    every = lambda sizes: F.explode(F.sequence(F.lit(0), F.get(sizes, F.col("cell")) - 1))
    schema = "id long, v array<double>, cell int"
    left = q.mapInArrow(_assign_cells(pivots, metric), schema).select("id", "v", "cell", part_of(q_lit).alias("_q")).withColumn("_c", every(c_lit))
    right = c.mapInArrow(_send(pivots, limits, metric, False), schema).select("id", "v", "cell", part_of(c_lit).alias("_c")).withColumn("_q", every(q_lit))
    keys = ["cell", "_q", "_c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_function(k, metric, exclude_self), EDGE_SCHEMA)
