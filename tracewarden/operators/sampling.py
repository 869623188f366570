"""Seeded sampling, stratified splits and folds on a distributed rank.

Every rank here is computed without a single-task window: rows fall into many buckets, bucket
sizes give offsets, and a row's rank is its place inside its bucket plus the offset.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
SORTED_LIMIT = 100_000  # a larger sample goes through the distributed rank


def hash_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def hash_rank(
    df: DataFrame, id_col: str = "row_id", by: str | None = None, seed: int = SEED,
    out: str = "rank", hex_digits: int | None = None,
) -> DataFrame:
    """0-based rank in hash order, over all rows or within each value of ``by``.

    16**hex_digits buckets; by default at least 16 for each shuffle partition, so that they grow with what the session is set up for.
    """
    if hex_digits is None:
        hex_digits = max(3, math.ceil(math.log(16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)))
    by_cols = [by] if by else []
    keyed = df.withColumn("_hash", hash_key(id_col, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, hex_digits)
    )
    before = Window.partitionBy(*by_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.select(*by_cols, F.substring(hash_key(id_col, seed), 1, hex_digits).alias("_bucket"))
        .groupBy(*by_cols, "_bucket").count()
        .select(
            *[F.col(c).alias(f"_by_{c}") for c in by_cols], F.col("_bucket").alias("_b"),
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = Window.partitionBy(*by_cols, "_bucket").orderBy("_hash", id_col)
    # null-safe, or the optimizer would filter on the hash first and compute it twice
    condition = F.col("_bucket").eqNullSafe(F.col("_b"))
    for c in by_cols:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return (
        keyed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, condition)
        .withColumn(out, F.col("_offset") + F.col("_place") - 1)
        .drop("_hash", "_bucket", "_b", "_offset", "_place", *[f"_by_{c}" for c in by_cols])
    )


def first_in_hash_order(df: DataFrame, n: int, id_col: str = "row_id", seed: int = SEED, total: int | None = None) -> DataFrame:
    """The n rows with the smallest hash key.

    The key is spread evenly, so a bound on its first digits leaves a few more than n rows to sort, however many
    partitions there are.  Where chance leaves fewer, all rows are ranked.
    """
    total = df.count() if total is None else total
    share = (n + 8 * n ** 0.5 + 32) / max(total, 1)
    if share >= 1:
        few = df
    else:
        few = df.where(F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
        if few.select(id_col).count() < n:
            return hash_rank(df, id_col, seed=seed, out="_rank").where(F.col("_rank") < n).drop("_rank")
    return few.orderBy(hash_key(id_col, seed), F.col(id_col)).limit(n)


def seeded_sample(df: DataFrame, n: int | None, id_col: str = "row_id", seed: int = SEED) -> DataFrame:
    """N rows without replacement; all rows when n is None, 0 or not below the row count."""
    if not n:
        return df
    if n <= SORTED_LIMIT:
        return first_in_hash_order(df, n, id_col, seed)
    return hash_rank(df, id_col, seed=seed, out="_rank").where(F.col("_rank") < n).drop("_rank")


def drop_duplicate_rows(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row per distinct content, the one with the smallest id."""
    content = [c for c in df.columns if c != id_col]
    return df.groupBy(*content).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def stratified_split(
    df: DataFrame, label_col: str = "label", id_col: str = "row_id", test_size: float = 0.2, seed: int = SEED,
) -> DataFrame:
    """Adds ``split`` (train/test); test holds ceil(test_size*n) rows in class proportion.

    Class shares are rounded by largest remainder, ties to the smaller label.
    """
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy(F.lit(0))
    quota = (
        sizes.withColumn("n_all", F.sum("n_class").over(everything))
        .withColumn("n_test", F.ceil(F.col("n_all") * F.lit(test_size)))
        .withColumn("share", F.col("n_class").cast("double") * F.col("n_test") / F.col("n_all"))
        .withColumn("base", F.floor("share"))
        .withColumn("spare", F.col("n_test") - F.sum("base").over(everything))
        .withColumn(
            "order",
            F.row_number().over(
                Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("share") - F.col("base"), 9).desc(), label_col)
            ),
        )
        .select(
            F.col(label_col).alias("_label"),
            (F.col("base") + F.when(F.col("order") <= F.col("spare"), 1).otherwise(0)).alias("_quota"),
        )
    )
    ranked = hash_rank(df, id_col, by=label_col, seed=seed, out="_rank")
    return (
        ranked.join(quota, F.col(label_col).eqNullSafe(F.col("_label")))
        .withColumn("split", F.when(F.col("_rank") < F.col("_quota"), "test").otherwise("train"))
        .drop("_rank", "_label", "_quota")
    )


def stratified_folds(
    df: DataFrame, k: int = 5, label_col: str = "label", id_col: str = "row_id", seed: int = SEED,
) -> DataFrame:
    """Adds ``fold`` in 0..k-1, each class spread evenly."""
    ranked = hash_rank(df, id_col, by=label_col, seed=seed, out="_rank")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """P5: balanced weight n / (classes * n_class) per label."""
    everything = Window.partitionBy(F.lit(0))
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    return sizes.select(
        label_col, "n_class",
        (F.sum("n_class").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n_class").cast("double"))).alias("weight"),
    )


def reasoning_sample_sizes(
    totals: DataFrame, anomaly_percentage: float = 1.0, min_samples: int = 3, max_samples: int = 8,
    normal_samples: int = 2,
) -> DataFrame:
    """Adds how many anomalies and normals to examine to ``(total_anomalies, total_normals)``."""
    wanted = F.greatest(F.lit(1), F.floor(F.col("total_anomalies") * F.lit(float(anomaly_percentage))))
    wanted = F.least(F.lit(max_samples), F.greatest(F.lit(min_samples), wanted))
    return totals.withColumn(
        "anomaly_samples", F.least(wanted, F.col("total_anomalies")).cast("long")
    ).withColumn("normal_samples", F.least(F.lit(normal_samples), F.col("total_normals")).cast("long"))


def pick_reasoning_rows(
    df: DataFrame, flag_col: str = "label", id_col: str = "row_id", anomaly_percentage: float = 1.0,
    min_samples: int = 3, max_samples: int = 8, normal_samples: int = 2, fallback: int = 5,
) -> DataFrame:
    """The first anomalies, then the first normals by position; the first rows if there are neither.

    At most ``max_samples + normal_samples`` rows come out, so each class is cut by a top-k sort
    (bounded per task) instead of a window over the class.
    """
    totals = df.agg(
        F.count_if(F.col(flag_col) == 1).alias("total_anomalies"),
        F.count_if(F.col(flag_col) == 0).alias("total_normals"),
    )
    size = reasoning_sample_sizes(totals, anomaly_percentage, min_samples, max_samples, normal_samples).first()
    anomalies, normals = size["anomaly_samples"], size["normal_samples"]

    def first(rows: DataFrame, limit: int, group: int) -> DataFrame:
        return rows.orderBy(id_col).limit(limit).withColumn("_group", F.lit(group))

    if anomalies + normals == 0:
        picked = first(df, fallback, 0)
    else:
        picked = first(df.where(F.col(flag_col) == 1), anomalies, 0).unionByName(first(df.where(F.col(flag_col) == 0), normals, 1))
    order = Window.partitionBy(F.lit(0)).orderBy("_group", id_col)  # a handful of rows
    return picked.withColumn("sample_order", F.row_number().over(order) - 1).select(*df.columns, "sample_order")


def union_parts(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both parts in one table, tagged by ``split``."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
