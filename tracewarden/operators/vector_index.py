"""A stored index of vectors in cells, so that a search reads the cells that matter and not the corpus.

An index is a folder:

``rows/batch=…/cell=…``  the rows (row_id, embedding and the columns to be kept), partitioned by the pivot they are nearest to
``cells``                one row per batch and cell: pivot, greatest distance of a row to it, number of rows

Rows of a batch are written before its cells, and only batches with cells are read: an interrupted write leaves nothing behind
that a search would see.  Pivots are fixed when the index is built; rows that are added later go to the nearest
one.  A cell whose pivot is farther from a query than the radius plus the distance within which the wanted neighbours are certain holds none of
them, so the result is exact.  With the cosine metric cells are made of unit vectors, and zero vectors lie in a cell of
their own that every search reads.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators.neighbors import EDGE_SCHEMA, FEW_BYTES, FEW_QUERIES, SLICE_ROWS, _no_edges, _stack, block_top_k, knn_join, without_copies

ROWS_PER_CELL, MAX_CELLS, ZERO_CELL = 20_000, 4096, -1
MARGIN = 1e-9  # of the bounds, for rounding


def _keys(vectors: np.ndarray, metric: str) -> np.ndarray:
    """The points whose Euclidean distances order the neighbours."""
    if metric == "l2":
        return vectors
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1.0)


def _matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64) if vectors else np.zeros((0, 0))


def _away(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sizes = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(sizes - 2.0 * (points @ pivots.T), 0.0))


def build(rows: DataFrame, folder: str, metric: str = "l2", vec_col: str = "embedding", rows_per_cell: int = ROWS_PER_CELL) -> str:
    """Write an index of ``rows`` (row_id, vectors of one size, any other columns) into an empty folder; gives the folder."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    vectors = rows.select("row_id", F.col(vec_col).cast("array<double>").alias("v"))
    n = vectors.count()
    wanted = int(min(MAX_CELLS, max(1, -(-n // rows_per_cell))))
    # a bounded number of rows, fixed by the hash of their id
    part = vectors.where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 20)) < int(min(1 << 20, max(64, (2 << 20) * wanted // max(1, n)))))
    order = [F.md5(F.col("row_id").cast("string")), F.col("row_id")]
    chosen = part.orderBy(*order).limit(wanted).collect() or vectors.orderBy(*order).limit(wanted).collect()
    points = _keys(_matrix([r["v"] for r in chosen]), metric)
    pivots = np.unique(points[np.any(points != 0, axis=1)] if metric == "cosine" else points, axis=0)
    spark = rows.sparkSession
    spark.createDataFrame([(metric, i, p.tolist()) for i, p in enumerate(pivots)] or [(metric, ZERO_CELL, [])], "metric string, cell int, pivot array<double>").coalesce(
        1).write.parquet(f"{folder}/pivots")
    kept = rows.select(*_kept(rows, vec_col), F.col(vec_col).cast("array<double>").alias("embedding"), F.lit(0.0).alias("away"), F.lit("").alias("batch"), F.lit(0).alias("cell"))
    spark.createDataFrame([(kept.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{folder}/schema")
    append(rows, folder, vec_col)
    return folder


def _kept(rows: DataFrame, vec_col: str) -> list[str]:
    """The columns that an index keeps as they are."""
    return [c for c in rows.columns if c not in {vec_col, "embedding", "cell", "batch", "away"}]


def _pivots(spark: SparkSession, folder: str) -> tuple[str, np.ndarray]:
    rows = spark.read.schema("metric string, cell int, pivot array<double>").parquet(f"{folder}/pivots").orderBy("cell").collect()  # at most MAX_CELLS
    found = [r["pivot"] for r in rows if r["cell"] != ZERO_CELL]
    return rows[0]["metric"], _matrix(found)


def append(rows: DataFrame, folder: str, vec_col: str = "embedding") -> None:
    """Add rows to an index; a row_id that is there already is there twice."""
    spark = rows.sparkSession
    metric, pivots = _pivots(spark, folder)
    state = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, away double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        points = _keys(_stack(vectors), metric)
        cell, distance = np.zeros(len(points), int), np.zeros(len(points))
        for start in range(0, len(points) if len(state.value) else 0, SLICE_ROWS):  # a table of rows by cells at a time
            away = _away(points[start:start + SLICE_ROWS], state.value)
            cell[start:start + SLICE_ROWS], distance[start:start + SLICE_ROWS] = away.argmin(axis=1), away.min(axis=1)
        zero = ~points.any(axis=1) if metric == "cosine" else np.full(len(points), not len(state.value))
        return pd.DataFrame({"cell": np.where(zero, ZERO_CELL, cell).astype(np.int32), "away": np.where(zero, 0.0, distance)})

    batch = uuid.uuid4().hex
    kept = _kept(rows, vec_col)
    placed = rows.select(*kept, F.col(vec_col).cast("array<double>").alias("embedding")).withColumn("_at", nearest("embedding")).select(
        *kept, "embedding", F.col("_at.away").alias("away"), F.lit(batch).alias("batch"), F.col("_at.cell").alias("cell"))
    # a cell's rows meet in as many tasks as they are dealt to, so that one dense cell does not fill one; few files for small cells
    deal = F.pmod(F.xxhash64("row_id"), F.lit(16))
    placed.repartition("cell", deal).write.partitionBy("batch", "cell").mode("append").parquet(f"{folder}/rows")
    written = _stored_rows(spark, folder).where(F.col("batch") == batch)
    facts = written.groupBy(F.col("cell").cast("int").alias("cell")).agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"))
    facts.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{folder}/cells")


def _stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{folder}/schema").first()["schema"]))
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def _stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("cell int, radius double, n long, d int, batch string").parquet(f"{folder}/cells")


def open_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of an index; a filter on ``cell`` reads those partitions alone."""
    batches = [r["batch"] for r in _stored_cells(spark, folder).select("batch").distinct().collect()]  # one row per append
    return _stored_rows(spark, folder).where(F.col("batch").isin(batches))


def _cells(spark: SparkSession, folder: str) -> pd.DataFrame:
    found = _stored_cells(spark, folder).groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"), F.max("d").alias("d"))
    return found.toPandas().sort_values("cell").reset_index(drop=True)  # at most MAX_CELLS + 1 rows


def cells_of_queries(queries: np.ndarray, pivots: np.ndarray, cells: pd.DataFrame, k: int, metric: str) -> np.ndarray:
    """Which rows of ``cells`` can hold one of the k nearest of each query: (query, cell) flags."""
    flags = np.zeros((len(queries), len(cells)), bool)
    real = cells["cell"].to_numpy() != ZERO_CELL
    flags[:, ~real] = True
    if not real.any():
        return flags
    numbers, radius, sizes = cells["cell"].to_numpy()[real], cells["radius"].to_numpy()[real], cells["n"].to_numpy()[real]
    away = _away(_keys(queries, metric), pivots[numbers])
    far = away + radius
    order = np.argsort(far, axis=1)
    held = np.cumsum(sizes[order], axis=1)
    at = np.minimum((held < k).sum(axis=1), len(numbers) - 1)
    bound = np.take_along_axis(far, order, 1)[np.arange(len(queries)), at]  # k rows are certainly within it
    bound = np.where(held[:, -1] < k, np.inf, bound)
    if metric == "cosine":  # every row is equally far from a zero vector
        bound = np.where(queries.any(axis=1), bound, np.inf)
    flags[:, real] = away - radius <= bound[:, None] * (1 + MARGIN) + MARGIN
    return flags


def search(queries: DataFrame, folder: str, top_k: int = 3, vec_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """R2 on a stored index: ``(query_id, neighbor_id, rank, distance)``, nearest first, ties by id.

    A few queries (of checked size) read only the cells that can matter to one of them.  More of them are joined with all rows.
    """
    spark = queries.sparkSession
    metric, pivots = _pivots(spark, folder)
    rows, cells = open_rows(spark, folder), _cells(spark, folder)
    size = int(cells["d"].max()) if len(cells) else 0
    few = queries.limit(FEW_QUERIES + 1).count()
    if few > FEW_QUERIES or few * size * 8 > FEW_BYTES:
        return knn_join(queries.withColumn("embedding", F.col(vec_col)), rows, top_k, metric=metric, exclude_self=exclude_self)
    asked = queries.select(F.col("row_id").cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).toPandas()
    points = _stack(asked["v"])
    need = top_k + (1 if exclude_self else 0)
    flags = cells_of_queries(points, pivots, cells, need, metric) if len(asked) else np.zeros((0, len(cells)), bool)
    wanted = cells["cell"].to_numpy()[flags.any(axis=0)].tolist()
    state = spark.sparkContext.broadcast((asked["id"].to_numpy(), points, dict(zip(cells["cell"].tolist(), flags.T))))

    def run(batches):
        ids, vectors, askers = state.value
        best = _no_edges()
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                who = np.flatnonzero(askers[int(cell)])
                own, near = part["id"].to_numpy(), _stack(part["v"])
                kept = without_copies(own, near, need)
                found = block_top_k(ids[who], vectors[who], own[kept], near[kept], top_k, metric, exclude_self)
                best = pd.concat([best, found]) if len(best) else found
            if len(best):
                best = best.sort_values(["query_id", "distance", "neighbor_id"])
                best = best[best.groupby("query_id").cumcount() < top_k]
        yield best

    read = rows.where(F.col("cell").isin(wanted)).select(F.col("row_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.col("cell").cast("int").alias("cell"))
    edges = read.mapInPandas(run, EDGE_SCHEMA)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return edges.withColumn("rank", place).where(F.col("rank") <= top_k).select("query_id", "neighbor_id", "rank", "distance")
