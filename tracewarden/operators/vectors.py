"""Centred PCA, contamination estimates and the local outlier factor's building blocks."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators.neighbors import knn_join
from tracewarden.operators.ranking import IN_PLAN_LIMIT, column_order_statistics, running_totals
from tracewarden.session import materialize

logger = logging.getLogger(__name__)

MAX_COMPONENTS = 768
Z_FACTOR = 0.6745
Z_CUT = 3.5
LOF_CUT = 1.5
RATE_RANGE = (0.001, 0.5)


@dataclass
class PcaModel:
    """Components as rows, with the mean they are centred on and each one's variance share."""

    mean: np.ndarray
    components: np.ndarray
    explained_ratio: np.ndarray

    def transform(self, df: DataFrame, vec_col: str = "embedding", out: str | None = None) -> DataFrame:
        """(v - mean) times the components, as array expressions: no Python in the row path.

        For wide models the projection goes through the library's matrix product instead.
        """
        return _project(df, self, vec_col, out or vec_col)


def _project(df: DataFrame, model: PcaModel, vec_col: str, out: str) -> DataFrame:
    if len(model.components) <= 4:
        v = F.col(vec_col).cast("array<double>")
        entries = []
        for row in model.components:
            weights = F.array(*[F.lit(float(x)) for x in row])
            shift = float(np.dot(model.mean, row))
            dot = F.aggregate(F.zip_with(v, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
            entries.append(dot - F.lit(shift))
        return df.withColumn(out, F.array(*entries))
    state = df.sparkSession.sparkContext.broadcast((model.mean, model.components))

    @F.pandas_udf("array<double>")
    def project(vectors):
        import pandas as pd
        mean, components = state.value
        return pd.Series(list((np.vstack(vectors.to_numpy()) - mean) @ components.T))

    return df.withColumn(out, project(F.col(vec_col).cast("array<double>")))


def vector_size(df: DataFrame, vec_col: str = "embedding") -> int:
    row = df.select(F.size(vec_col).alias("d")).where(F.col("d") >= 0).first()
    return int(row["d"]) if row else 0


def fit_pca(df: DataFrame, k: int, vec_col: str = "embedding") -> PcaModel:
    """V1: principal components of the centred vectors, largest loading made positive."""
    vectors = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    components = model.pc.toArray().T
    pick = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(len(components)), pick])
    mean = vectors.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    return PcaModel(mean, components * signs[:, None], model.explainedVariance.toArray())


def reduce_dimensionality(df: DataFrame, target_dim: int = MAX_COMPONENTS, method: str = "pca", vec_col: str = "embedding"):
    """V1: ``(table, model)``; unchanged and None when the vectors are small enough already."""
    if vector_size(df, vec_col) <= target_dim:
        return df, None
    if method != "pca":
        raise ValueError(f"unknown reduction method: {method}")
    model = fit_pca(df, target_dim, vec_col)
    return model.transform(df, vec_col), model


def fit_train_apply_all(df: DataFrame, target_dim: int = MAX_COMPONENTS, vec_col: str = "embedding", n_train: int | None = None):
    """V2: fit on ``split = 'train'``, apply to all rows; components capped by the training size."""
    size = vector_size(df, vec_col)
    if size <= target_dim:
        return df, None
    train = df.where(F.col("split") == "train")
    rows = train.count() if n_train is None else n_train
    model = fit_pca(train, max(1, min(target_dim, rows - 1, size)), vec_col)
    return model.transform(df, vec_col), model


def projection_table(df: DataFrame, vec_col: str = "embedding", label_col: str = "label"):
    """V3: ``(row_id, split, label, pc1, pc2)`` fitted on the training rows, and the variance share kept."""
    if vector_size(df, vec_col) > 2:
        model = fit_pca(df.where(F.col("split") == "train"), 2, vec_col)
        flat, share = model.transform(df, vec_col, "_xy"), float(model.explained_ratio.sum())
    else:
        flat, share = df.withColumn("_xy", F.col(vec_col)), 1.0
    return flat.select("row_id", "split", label_col, F.get("_xy", 0).alias("pc1"), F.get("_xy", 1).alias("pc2")), share


def series_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """V3: legend entries, e.g. ``Train Normal (n=12)``."""
    name = F.when(F.col(label_col) == 0, "Normal").otherwise("Anomaly")
    return df.groupBy("split", label_col).agg(F.count(F.lit(1)).alias("n")).select(
        "split", label_col, "n", F.concat(F.initcap("split"), F.lit(" "), name, F.lit(" (n="), F.col("n").cast("string"), F.lit(")")).alias("series"),
    )


# --------------------------------------------------------------------------- contamination


def _medians(df: DataFrame, vec_col: str, rows: int, size: int) -> list[float]:
    if rows <= IN_PLAN_LIMIT:
        cells = df.select(F.posexplode(vec_col).alias("j", "x")).groupBy("j").agg(F.percentile("x", F.lit(0.5)).alias("m"))
        return [r["m"] for r in cells.orderBy("j").collect()]
    low, high = (rows - 1) // 2, rows // 2
    both = column_order_statistics(df, vec_col, size, [low, high])
    return [float(x) for x in both.mean(axis=1)]


def contamination_statistical(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """V5: share of rows with any entry whose modified z-score exceeds the cut (before the clamp).

    An entry whose column has no spread is an outlier exactly when it differs from the median.
    """
    vectors = df.select(F.col(vec_col).cast("array<double>").alias("v"))
    rows, size = vectors.count(), vector_size(vectors, "v")
    median = F.array(*[F.lit(m) for m in _medians(vectors, "v", rows, size)])
    deviations = vectors.select(F.zip_with("v", median, lambda x, m: F.abs(x - m)).alias("v"))
    spread = F.array(*[F.lit(m) for m in _medians(deviations, "v", rows, size)])
    outlier = F.exists(
        F.zip_with("v", spread, lambda dev, mad: F.when(mad == 0, dev > 0).otherwise(F.lit(Z_FACTOR) * dev / mad > Z_CUT)),
        lambda hit: hit,
    )
    return deviations.agg(F.avg(outlier.cast("double")).alias("contamination"))


def contamination_elbow(df: DataFrame, k: int = 10, vec_col: str = "embedding", edges: DataFrame | None = None) -> DataFrame:
    """V6: position of the first largest jump in the sorted k-th neighbour distances."""
    found = edges if edges is not None else knn_join(df, df, k, vec_col=vec_col)
    kth = materialize(found.where(F.col("rank") == k).select(F.col("distance").alias("d")))
    n = kth.count()
    table = running_totals(kth, "d", {"n": F.lit(1)})
    # successive distinct values: inside a range by `lead`, across ranges by the next range's minimum
    inside = Window.partitionBy("_part").orderBy("d")
    ends = table.groupBy("_part").agg(F.min("d").alias("_min")).select(
        "_part", F.lead("_min").over(Window.orderBy("_part")).alias("_next_min")  # one row per range
    )
    jumps = (
        table.withColumn("_next", F.lead("d").over(inside)).join(ends, "_part")
        .withColumn("jump", F.coalesce("_next", "_next_min") - F.col("d"))
        .withColumn("idx", F.col("n_below") + F.col("n") - 1)
    )
    first = jumps.where(F.col("jump").isNotNull()).agg(
        F.max_by("idx", F.struct("jump", -F.col("idx"))).alias("idx")
    )
    return first.select((F.lit(1.0) - F.coalesce("idx", F.lit(0)) / F.lit(float(n))).alias("contamination"))


def contamination_density(df: DataFrame, k: int = 10, vec_col: str = "embedding") -> DataFrame:
    """V7: share of rows whose local outlier factor exceeds 1.5."""
    from tracewarden.operators.lof import local_outlier_factor
    lof = local_outlier_factor(df, k, vec_col)
    return lof.agg(F.avg((F.col("lof") > LOF_CUT).cast("double")).alias("contamination"))


def clamp_rate(col: Column) -> Column:
    return F.greatest(F.lit(RATE_RANGE[0]), F.least(F.lit(RATE_RANGE[1]), col))


def estimate_contamination(df: DataFrame, method: str = "statistical", k: int = 10, vec_col: str = "embedding") -> float:
    """V5–V8: the estimate, held within [0.001, 0.5]."""
    if method == "statistical":
        found = contamination_statistical(df, vec_col)
    elif method == "elbow":
        found = contamination_elbow(df, k, vec_col)
    elif method == "density":
        found = contamination_density(df, k, vec_col)
    else:
        raise ValueError(f"unknown contamination estimation method: {method}")
    return float(found.select(clamp_rate(F.col("contamination")).alias("c")).first()["c"])


def resolve_contamination(df: DataFrame, setting: str | float, vec_col: str = "embedding") -> float:
    """V8: a number (clamped), or 'auto'; anything unreadable falls back to 'auto' with a warning."""
    if setting != "auto":
        try:
            return max(RATE_RANGE[0], min(RATE_RANGE[1], float(setting)))
        except ValueError:
            logger.warning("contamination %r is not a number, estimating it", setting)
    return estimate_contamination(df, "statistical", vec_col=vec_col)
