"""Centroid clustering whose nearest centroids come from an equal-average equal-variance search.

A vector x of d components with sum S and deviation V (the length of x less its mean) has from a centroid c a squared distance of at
least ``(S_x - S_c)**2 / d + (V_x - V_c)**2``.  Centroids are sorted by their mean.  From the vector's own mean the
search goes outward on both sides, nearer means first: once the means alone are too far apart it ends, and a centroid whose
deviation is too far off is passed over; the others are compared in exact integers.  The bounds are worked out in
floating point and given a margin, so they never drop a centroid that is as near as the best.

Every round is one pass over the table: each task adds up its own clusters, and only sums travel.  Assignments are not kept
between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import store

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64.0
BOUND = 1 << 27  # components beyond it are taken as it, so that sums and distances stay exact in 64 bits
MARGIN, CHUNK = 1e-9, 8192


def usable(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, vector)`` with ``dimensions`` components, none of them null, NaN or infinite."""
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size("vector") == dimensions) & sound)


def integers(column: pa.Array, dimensions: int) -> np.ndarray:
    """floor(SCALE * x) of every component, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return np.floor(np.clip(SCALE * flat, -BOUND, BOUND)).astype(np.int64)


def _deviation(points: np.ndarray) -> np.ndarray:
    real = points.astype(np.float64)
    return np.sqrt(((real - real.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


class EqualAverageIndex:
    """Centroids in order of their mean, with their deviations."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.order = np.lexsort((np.arange(len(sums)), sums))
        self.points, self.sums = centroids[self.order], sums[self.order].astype(np.float64)
        self.deviations = _deviation(self.points)
        self.compared = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(centroid, squared distance)`` of each row; of equally near centroids the one with the smaller number."""
        n, d = points.shape
        k = len(self.points)
        sums, deviations = points.sum(axis=1).astype(np.float64), _deviation(points)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
        active = np.arange(n)
        while len(active):
            u, w = up[active], down[active]
            above = np.where(u < k, self.sums[np.minimum(u, k - 1)] - sums[active], np.inf)
            below = np.where(w >= 0, sums[active] - self.sums[np.maximum(w, 0)], np.inf)
            takes_up = above <= below
            apart = np.where(takes_up, above, below) ** 2 / d
            limit = best[active] * (1.0 + MARGIN) + MARGIN
            near = apart <= limit  # else no mean further out can do better
            active, takes_up, apart, limit = active[near], takes_up[near], apart[near], limit[near]
            at = np.where(takes_up, up[active], down[active])
            up[active] += takes_up
            down[active] -= ~takes_up
            open_ = apart + (deviations[active] - self.deviations[at]) ** 2 <= limit
            rows, at = active[open_], at[open_]
            self.compared += len(rows)
            away = points[rows] - self.points[at]
            distance, own = np.einsum("ij,ij->i", away, away), self.order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], own[better]
            active = active[(up[active] < k) | (down[active] >= 0)]
        return number, best


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``1:<vec_id>``; equal ids go by their components, a null id is spelled null."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select("vector", key.alias("key")).orderBy("key", "vector").limit(k).select("vector").collect()
    return np.floor(np.clip(SCALE * np.array([r.vector for r in rows], np.float64), -BOUND, BOUND)).astype(np.int64)


def move(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; one without vectors stays."""
    k, d = centroids.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, sums = EqualAverageIndex(centroids), np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            points = integers(batch.column(0), d)
            for at in range(0, len(points), CHUNK):
                part = points[at:at + CHUNK]
                number, _ = index.nearest(part)
                order = np.argsort(number, kind="stable")
                starts = np.flatnonzero(np.diff(number[order], prepend=-1))
                sums[number[order][starts]] += np.add.reduceat(part[order], starts, axis=0)
                counts += np.bincount(number, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("vector").mapInArrow(rows, "cluster int, n long, sums array<long>")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"))
    moved = centroids.copy()
    for r in summed.collect():  # one row per centroid
        moved[r.cluster] = [s // r.n for s in r.sums]
    return moved


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per usable vector.

    ``rows``: vec_id, embedding; other columns are left out.  Vectors that are null, of another size, or with null or non-finite
    components take no part.  Rows that repeat a vec_id, or hold a null one, are vectors of their own; fewer vectors than ``k`` give as
    many centroids, none give no rows.  Scaled components are bounded by 2**27; an inertia beyond 64 bits is null.
    """
    vectors = usable(rows, dimensions)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = move(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = EqualAverageIndex(centroids)
        for batch in batches:
            points = integers(batch.column(1), dimensions)
            for at in range(0, len(points), CHUNK):
                number, distance = index.nearest(points[at:at + CHUNK])
                yield pa.record_batch([batch.column(0).slice(at, CHUNK), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = store(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(c, fits(total), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in sums.items()]
    table = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
