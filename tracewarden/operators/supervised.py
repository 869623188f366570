"""Cross-validated classifiers: one out-of-fold table, scored by grouped aggregations."""

from __future__ import annotations

import logging
import time
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.arrays import clean_vector
from tracewarden.operators import extra_trees, metrics
from tracewarden.operators.sampling import SEED, stratified_folds, stratified_split
from tracewarden.operators.vectors import MAX_COMPONENTS, projection_table, reduce_dimensionality
from tracewarden.session import brief, materialize, side_by_side

logger = logging.getLogger(__name__)

FOLDS = 5
PARALLEL_FITS = 4
REPORTED = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def logistic_regression(weight_sum: float, c: float = 1.0):
    """M1: L2 penalty of strength C on the summed loss, expressed for the averaged loss."""
    return LogisticRegression(
        maxIter=2000, tol=1e-6, regParam=1.0 / (c * weight_sum), elasticNetParam=0.0, standardization=False,
        weightCol="weight", featuresCol="_vec",
    )


def decision_tree(weight_sum: float):
    """M2."""
    return DecisionTreeClassifier(maxDepth=10, maxBins=256, seed=SEED, weightCol="weight", featuresCol="_vec")


def random_forest(weight_sum: float):
    """M3; trees end at the deepest level that the library knows.

    Each row's node in each tree is kept between levels: without that every level sends all rows down from the roots again.
    """
    return RandomForestClassifier(
        numTrees=100, maxDepth=30, featureSubsetStrategy="sqrt", cacheNodeIds=True, seed=SEED, weightCol="weight", featuresCol="_vec",
    )


CLASSIFIERS = {"LogReg": logistic_regression, "DecisionTree": decision_tree, "RandomForest": random_forest}


def _balanced(counts: dict, fold: int) -> tuple[Column, float]:
    """Balanced class weights of the rows outside ``fold``."""
    sizes: dict[int, int] = {}
    for (f, label), n in counts.items():
        if f != fold:
            sizes[label] = sizes.get(label, 0) + n
    total = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for label, n in sizes.items():
        weight = F.when(F.col("label") == label, F.lit(total / (len(sizes) * n))).otherwise(weight)
    return weight, float(total)


def out_of_fold(df: DataFrame, classifiers: dict | None = None, folds: int = FOLDS, vec_col: str = "embedding"):
    """M5: ``(predictions, timings, errors)``.

    predictions: one long table (row_id, model, fold, label, pred, score).  The fold column is fixed
    once; the training table is cached for the fits, which run a few at a time.
    """
    models = classifiers or CLASSIFIERS
    base = materialize(stratified_folds(
        df.select("row_id", F.col(vec_col).cast("array<double>").alias("_arr"), F.col("label").cast("int").alias("label")), folds
    ))
    data = base.withColumn("_vec", array_to_vector("_arr")).drop("_arr").persist()
    counts = {(r["fold"], r["label"]): r["count"] for r in data.groupBy("fold", "label").count().collect()}
    timings: list[tuple[str, float]] = []
    errors: dict[str, str] = {}

    def fit(task: tuple[str, int]) -> DataFrame:
        name, fold = task
        weight, weight_sum = _balanced(counts, fold)
        train = data.where(F.col("fold") != fold).withColumn("weight", weight)
        model = models[name](weight_sum).fit(train)
        scored = model.transform(data.where(F.col("fold") == fold))
        return scored.select(
            "row_id", F.lit(name).alias("model"), "fold", "label", F.col("prediction").cast("int").alias("pred"),
            vector_to_array("probability").alias("_p"),
        ).select("row_id", "model", "fold", "label", "pred", F.get("_p", 1).alias("score"))

    parts: list[DataFrame] = []
    for name in models:
        started = time.time()
        try:
            with ThreadPool(PARALLEL_FITS) as pool:
                scored = pool.map(fit, [(name, f) for f in range(folds)])
            table = scored[0]
            for other in scored[1:]:
                table = table.unionByName(other)
            parts.append(materialize(table))
            timings.append((name, time.time() - started))
        except Exception as error:  # noqa: BLE001 - one model's failure becomes an error row
            logger.error("%s failed: %s", name, brief(error))
            errors[name] = brief(error)
    data.unpersist()
    if not parts:
        return None, timings, errors
    table = parts[0]
    for other in parts[1:]:
        table = table.unionByName(other)
    return table, timings, errors


def fold_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """E1, E3, E4 and E5 per model and fold."""
    return metrics.binary_metrics(predictions, by).join(metrics.ranking_metrics(predictions, by), by)


def evaluate_classifiers_cv(df: DataFrame, classifiers: dict | None = None, folds: int = FOLDS, vec_col: str = "embedding") -> DataFrame:
    """M5: one row per classifier: mean and deviation of each metric, the fold values, PR-AUC, timing.

    A classifier that fails has its message in ``error`` and nulls elsewhere.
    """
    spark = df.sparkSession
    predictions, timings, errors = out_of_fold(df, classifiers, folds, vec_col)
    failed = spark.createDataFrame([(n, e) for n, e in errors.items()], "model string, error string")
    if predictions is None:
        return failed
    per_fold = materialize(fold_metrics(predictions, ["model", "fold"]))
    summary = metrics.fold_summary(per_fold, REPORTED, ["model"])
    # one value per fold, so the lists are as short as the fold count
    in_order = F.sort_array(F.collect_list(F.struct("fold", *REPORTED)))
    lists = per_fold.groupBy("model").agg(in_order.alias("_f")).select("model", *[F.col(f"_f.{m}").alias(f"{m}_scores") for m in REPORTED])
    overall = metrics.ranking_metrics(predictions, ["model"]).select("model", F.col("average_precision").alias("pr_auc"))
    hard = metrics.ranking_metrics(predictions.withColumn("score", F.col("pred").cast("double")), ["model"]).select(
        "model", F.col("average_precision").alias("pr_auc_hard")
    )
    rows = predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    clock = spark.createDataFrame(timings, "model string, eval_time double")
    good = (
        summary.join(lists, "model").join(overall, "model").join(hard, "model").join(clock, "model").join(rows, "model")
        .withColumn("eval_time_per_sample", F.col("eval_time") / F.col("n_rows")).drop("n_rows")
    )
    return good.unionByName(failed, allowMissingColumns=True)


def evaluate_extratrees_cv(df: DataFrame, n_splits: int = FOLDS, multi_class: bool = False, vec_col: str = "features", trees: int = extra_trees.TREES) -> DataFrame:
    """M6: one row of fold means and deviations for extra-trees, with dataset facts.

    ``label`` holds codes 0..k-1.  Training and prediction of a fold are both inside its reported time.
    """
    base = materialize(stratified_folds(
        df.select("row_id", F.col(vec_col).cast("array<double>").alias("features"), F.col("label").cast("int").alias("label")), n_splits
    ))
    classes = int(base.agg(F.max("label").alias("m")).first()["m"]) + 1
    sizes = {r["fold"]: r["count"] for r in base.groupBy("fold").count().collect()}
    parts, clock = [], []
    for fold in sorted(sizes):
        started = time.time()
        parts.append(materialize(extra_trees.out_of_fold(base, n_splits, max(classes, 2), trees, only=fold)))
        clock.append((fold, (time.time() - started) * 1e6 / sizes[fold]))
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    times = base.sparkSession.createDataFrame(clock, "fold int, prediction_time_per_sample_us double")
    by = ["fold"]
    if multi_class:
        auc = metrics.one_vs_rest_auc(predictions, by)
        per_fold = metrics.weighted_metrics(predictions, by).join(auc, by)
        names = REPORTED
    else:
        scored = predictions.withColumn("score", F.get("scores", 1))
        per_fold = fold_metrics(scored, by)
        names = [*REPORTED, "dr", "far"]
    names = [*names, "prediction_time_per_sample_us"]
    summary = metrics.fold_summary(per_fold.join(times, "fold"), names).withColumnsRenamed({f"{m}_mean": m for m in names})
    facts = metrics.dataset_facts(base)
    spread = metrics.class_distribution(base).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cls", "n"))), lambda s: s["n"]).alias("class_distribution")
    )
    return side_by_side(summary, facts, spread).withColumns({
        "n_splits": F.lit(n_splits),
        "classifier": F.lit("ExtraTreesClassifier"), "n_estimators": F.lit(trees),
        "classification_type": F.lit("multiclass" if multi_class else "binary"),
    })


def evaluate_flows(spark, train, test, nlines: int | None = None) -> DataFrame | None:
    """M7: extra-trees on the union of both flow files, binary and, with more than two categories,
    multi-class.  Codes and ranges are fitted once on the union.  None when nothing can be evaluated.
    """
    from tracewarden.operators import encoding
    from tracewarden.sources import loaders
    try:
        both = [loaders.seeded_or_all(spark, source, nlines).withColumn("_part", F.lit(i)) for i, source in enumerate((train, test))]
        rows = both[0].unionByName(both[1], allowMissingColumns=True)
        # ids of the two files overlap; interleave them
        rows = materialize(rows.withColumn("row_id", F.col("row_id") * 2 + F.col("_part")).drop("_part"))
        binary = loaders.load_unsw_nb15_cleaned(spark, rows)
        results = [evaluate_extratrees_cv(binary)]
        if "attack_cat" in rows.columns:
            coded = loaders.load_unsw_nb15_cleaned(spark, rows, label_col="attack_cat", multi_class=True)
            if coded.select("label").distinct().count() > 2:
                results.append(evaluate_extratrees_cv(coded, multi_class=True))
    except Exception as error:  # noqa: BLE001 - no result instead of an exception
        logger.error("flow evaluation failed: %s", error)
        return None
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def evaluate_embeddings_cv(df: DataFrame, approach: str, dataset_type: str = "unsw-nb15", vec_col: str = "embedding", classifiers: dict | None = None) -> DataFrame:
    """M8: result rows per classifier on cleaned, if need be reduced, vectors."""
    cleaned = df.withColumn(vec_col, clean_vector(F.col(vec_col)))
    reduced, model = reduce_dimensionality(cleaned, MAX_COMPONENTS, vec_col=vec_col)
    table = evaluate_classifiers_cv(reduced, classifiers, vec_col=vec_col)
    if "accuracy_mean" not in table.columns:
        logger.warning("no classifier could be evaluated")
        return table.limit(0)
    out = table.where(F.col("error").isNull()).select(
        F.lit(f"{approach}_llm").alias("approach"), F.col("model").alias("classifier"), F.col("accuracy_mean").alias("acc"),
        F.col("f1_mean").alias("f1"), F.col("roc_auc_mean").alias("roc_auc"),
        F.lit("research_compliant_llm_embeddings").alias("eval_type"),
        F.lit("5_fold_cv_plus_pca" if model else "5_fold_cv_no_pca").alias("methodology"), F.lit(dataset_type).alias("dataset_type"),
    )
    if model:
        out = out.withColumn("pca_explained_variance", F.lit(float(model.explained_ratio.sum())))
    return out


def prepare_evaluation_data(df: DataFrame, vec_col: str = "embedding", target_dim: int = MAX_COMPONENTS) -> dict:
    """M9: reduction, stratified split, 2-D projection and the split summary."""
    reduced, model = reduce_dimensionality(df, target_dim, vec_col=vec_col)
    parts = materialize(stratified_split(reduced))
    projected, share = projection_table(parts, vec_col)
    return {
        "data": parts, "projection": projected, "projection_share": share, "summary": metrics.split_summary(parts),
        "pca_applied": model is not None, "pca_explained_variance": float(model.explained_ratio.sum()) if model else 1.0,
    }
