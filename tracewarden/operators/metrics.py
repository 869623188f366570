"""Evaluation metrics as aggregations over prediction tables.

``by`` names grouping columns (model, fold, ...), so one pass scores every model and fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.arrays import l2_norm
from tracewarden.operators.ranking import IN_PLAN_LIMIT, quantiles, running_totals
from tracewarden.session import materialize

CENTROID_BLOCK = 1024


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame, by: list[str] | None = None, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, detection and false-alarm rate."""
    y, p = F.col(label_col), F.col(pred_col)
    counts = df.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y != 1) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p != 1)).alias("fn"), F.count_if((y != 1) & (p != 1)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
        .withColumn("dr", ratio(tp, tp + fn))
        .withColumn("far", ratio(fp, fp + tn))
    )


def weighted_metrics(df: DataFrame, by: list[str] | None = None, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 over all classes.

    The (label, prediction) pairs are counted first; everything after that is class-sized.
    """
    by = by or []
    pairs = df.groupBy(*by, F.col(label_col).alias("y"), F.col(pred_col).alias("p")).count()
    roles = pairs.select(
        *by, "y", "p", "count",
        F.explode(F.array(
            F.struct(F.col("y").alias("cls"), F.col("count").alias("support"), F.lit(0).cast("long").alias("chosen")),
            F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("count").alias("chosen")),
        )).alias("r"),
    )
    per_class = roles.groupBy(*by, "r.cls").agg(
        F.sum("r.support").alias("support"), F.sum("r.chosen").alias("chosen"),
        F.sum(F.when((F.col("y") == F.col("p")), F.col("r.support")).otherwise(0)).alias("hit"),
    )
    scored = per_class.withColumn("_p", ratio(F.col("hit"), F.col("chosen"))).withColumn(
        "_r", ratio(F.col("hit"), F.col("support"))
    )
    weight = F.sum("support")
    return scored.groupBy(*by).agg(
        weight.alias("n_samples"),
        ratio(F.sum("hit"), weight).alias("accuracy"),
        ratio(F.sum(F.col("_p") * F.col("support")), weight).alias("precision"),
        ratio(F.sum(F.col("_r") * F.col("support")), weight).alias("recall"),
        ratio(F.sum(f1_of(F.col("_p"), F.col("_r")) * F.col("support")), weight).alias("f1"),
    )


def ranking_metrics(
    df: DataFrame, by: list[str] | None = None, label_col: str = "label", score_col: str = "score",
) -> DataFrame:
    """ROC-AUC with tied scores counted half, and step-wise average precision.

    Both are 0 when a class is missing.
    """
    by = by or []
    y = F.col(label_col)
    table = running_totals(
        df.select(*by, y, F.col(score_col).cast("double").alias("_s")), "_s",
        {"pos": F.when(y == 1, 1).otherwise(0), "neg": F.when(y == 1, 0).otherwise(1)}, by,
    )
    sizes = table.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if by:
        keyed = table.join(sizes, by)
    else:
        total = sizes.first()
        keyed = table.withColumns({c: F.lit(total[c] or 0).cast("long") for c in ("n_pos", "n_neg")})
    # products of counts outgrow a long, so they are taken as doubles
    pos = F.col("pos").cast("double")
    hits_from = F.col("n_pos") - F.col("pos_below")
    rows_from = hits_from + F.col("n_neg") - F.col("neg_below")
    return keyed.groupBy(*by).agg(
        ratio(F.sum(pos * (F.col("neg_below") + F.col("neg") / 2)), F.max("n_pos").cast("double") * F.max("n_neg")).alias("roc_auc"),
        F.when(F.least(F.max("n_neg"), F.max("n_pos")) == 0, F.lit(0.0)).otherwise(
            ratio(F.sum(pos * (hits_from / rows_from)), F.max("n_pos"))
        ).alias("average_precision"),
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
    )


def one_vs_rest_auc(df: DataFrame, by: list[str] | None = None, label_col: str = "label", scores_col: str = "scores") -> DataFrame:
    """E4, multi-class: macro mean of the AUC of every class against the rest.

    ``scores`` holds one score per class code.
    """
    by = by or []
    long = df.select(*by, label_col, F.posexplode(scores_col).alias("cls", "score"))
    binary = long.withColumn("label", (F.col(label_col) == F.col("cls")).cast("int"))
    return ranking_metrics(binary, [*by, "cls"]).groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc"))


def fold_summary(fold_metrics: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return fold_metrics.groupBy(*(by or [])).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics]
    )


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class code, absent codes included with 0."""
    counts = df.groupBy(F.col(label_col).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    codes = counts.agg(F.max("cls").alias("top")).select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("cls"))
    return codes.join(counts, "cls", "left").select(F.col("cls").cast("int").alias("cls"), F.coalesce("n", F.lit(0)).alias("n"))


def dataset_facts(df: DataFrame, label_col: str = "label", features_col: str = "features") -> DataFrame:
    """Rows, feature count and class count."""
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(F.size(features_col)).cast("long").alias("n_features"),
        F.count_distinct(label_col).alias("n_classes"),
    )


def detection_counts(df: DataFrame, flag_col: str = "is_anomaly", by: list[str] | None = None) -> DataFrame:
    """Rows, anomalies, normals and the anomaly share."""
    n, hits = F.count(F.lit(1)), F.coalesce(F.sum(F.col(flag_col).cast("long")), F.lit(0))
    return df.groupBy(*(by or [])).agg(
        n.alias("num_samples"), hits.alias("num_anomalies"), (n - hits).alias("num_normal"),
        ratio(hits, n).alias("anomaly_ratio"),
    )


def score_statistics(df: DataFrame, score_col: str = "score", flag_col: str = "is_anomaly", n: int | None = None) -> DataFrame:
    """Spread and quantiles of the scores, and how far anomalies sit from normals."""
    s, flag = F.col(score_col).cast("double"), F.col(flag_col)
    names = ["score_median", "score_25th", "score_75th", "score_95th", "score_99th"]
    probs = [0.5, 0.25, 0.75, 0.95, 0.99]
    rows = df.count() if n is None else n
    if rows <= IN_PLAN_LIMIT:
        cuts = [F.percentile(s, F.lit(p)).alias(name) for name, p in zip(names, probs)]
    else:
        values = quantiles(df.select(s.alias("_s")), "_s", probs, rows)
        cuts = [F.lit(v).alias(name) for name, v in zip(names, values)]
    both = (F.count_if(flag == 1) > 0) & (F.count_if(flag == 0) > 0)
    hit, rest = F.avg(F.when(flag == 1, s)), F.avg(F.when(flag == 0, s))
    return df.agg(
        F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"), F.min(s).alias("score_min"),
        F.max(s).alias("score_max"), *cuts,
        F.when(both, hit).alias("score_anomaly_mean"), F.when(both, rest).alias("score_normal_mean"),
        F.when(both, hit - rest).alias("score_separation"),
    )


def embedding_statistics(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Dimension, mean and population deviation of the vector length."""
    norm = l2_norm(F.col(vec_col))
    return df.agg(
        F.max(F.size(vec_col)).alias("embedding_dim"), F.avg(norm).alias("embedding_mean_norm"),
        F.stddev_pop(norm).alias("embedding_std_norm"),
    )


def davies_bouldin(df: DataFrame, cluster_col: str = "cluster_id", vec_col: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centroid distance.

    Noise (-1) is left out; null below two clusters.  Centroids come from one partial aggregation
    over (cluster, dimension); they meet in pairs of blocks, so no task holds more than two blocks of them.
    """
    rows = df.where(F.col(cluster_col) != -1).select(F.col(cluster_col).alias("c"), id_col, F.col(vec_col).cast("array<double>").alias("v"))
    centroids = _centroids(rows)
    spread = materialize(
        rows.join(centroids, "c")
        .withColumn("d", _distance(F.col("v"), F.col("m")))
        .groupBy("c").agg(F.avg("d").alias("s"))
        .join(centroids, "c")
    )
    blocks = max(1, -(-spread.count() // CENTROID_BLOCK))
    own = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    dealt = spread.select("c", "s", "m", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(
        "c", "s", "m", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    worst = dealt.groupBy("low", "high").applyInPandas(_worst_ratios, spread.select("c", F.col("s").alias("w")).schema)
    return worst.groupBy("c").agg(F.max("w").alias("w")).agg(F.avg("w").alias("davies_bouldin_score"))


def _worst_ratios(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each cluster of two blocks the greatest (spread + spread) / distance to one of the other block, or of the only block."""
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    found = []
    for mine, theirs in {(low, high), (high, low)}:
        a, b = pdf[pdf["own"] == mine], pdf[pdf["own"] == theirs]
        if not len(a) or not len(b):
            continue
        others, names, spread = np.vstack(b["m"].to_numpy()), b["c"].to_numpy(), b["s"].to_numpy()
        for c, s, m in zip(a["c"], a["s"], a["m"]):
            gap = np.sqrt(((others - np.asarray(m)) ** 2).sum(axis=1))
            ratio_ = np.divide(spread + s, gap, out=np.zeros_like(gap), where=gap > 0)[names != c]
            if len(ratio_):
                found.append((c, float(ratio_.max())))
    return pd.DataFrame(found, columns=["c", "w"])


def _centroids(rows: DataFrame) -> DataFrame:
    cells = rows.select("c", F.posexplode("v").alias("j", "x")).groupBy("c", "j").agg(F.avg("x").alias("x"))
    # one entry per dimension, so the list is as long as a vector
    return cells.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("e")).select(
        "c", F.transform("e", lambda e: e["x"]).alias("m")
    )


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def split_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows and anomaly share per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col(label_col).cast("double")).alias("anomaly_ratio"))


def seconds_per_thousand(seconds: Column, lines: Column) -> Column:
    """E14."""
    return F.when(lines > 0, seconds / (lines / F.lit(1000.0))).otherwise(F.lit(0.0))
