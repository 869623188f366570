"""Queries: evaluation metrics and cross-validated classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.operators import metrics, sampling, supervised
from tracewarden.plans.catalog_rows import fixed
from tracewarden.plans.inputs import SCORED_SQL, VECTORS_SQL, flows, scored, vectors
from tracewarden.plans.registry import query
from tracewarden.sources import loaders

RATES_SQL = """tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS dr, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS far"""
COUNTS_SQL = """count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn"""
RATES = ["accuracy", "precision", "recall", "f1", "dr", "far"]


@query(f"WITH {SCORED_SQL}, c AS (SELECT model, {COUNTS_SQL} FROM scored GROUP BY model) SELECT model, {RATES_SQL} FROM c")
def binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(scored(spark, sf_dir), ["model"]).select("model", "tp", "fp", "fn", "tn", *fixed(RATES))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT unnest([0, 1, 2]) AS c), per AS (SELECT c, count(*) FILTER (WHERE class = c) AS support, count(*) FILTER (WHERE class_pred = c) AS chosen,
 count(*) FILTER (WHERE class = c AND class_pred = c) AS hit FROM scored, k GROUP BY c),
r AS (SELECT *, coalesce(hit / nullif(chosen, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS q FROM per)
SELECT CAST(sum(support) AS BIGINT) AS n_samples, round(sum(hit) / sum(support), 9) AS accuracy, round(sum(p * support) / sum(support), 9) AS precision,
round(sum(q * support) / sum(support), 9) AS recall, round(sum(coalesce(2 * p * q / nullif(p + q, 0), 0) * support) / sum(support), 9) AS f1 FROM r""")
def weighted_metrics(spark, sf_dir):
    found = metrics.weighted_metrics(scored(spark, sf_dir), label_col="class", pred_col="class_pred")
    return found.select("n_samples", *fixed(["accuracy", "precision", "recall", "f1"]))


def ranking_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""g AS (SELECT {cols}score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM base GROUP BY ALL),
w AS (SELECT *, sum(p) OVER ({part}) AS tp_all, sum(n) OVER ({part}) AS tn_all, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
 sum(p) OVER ({part} ORDER BY score DESC) AS hits, sum(p + n) OVER ({part} ORDER BY score DESC) AS seen FROM g)
SELECT {cols}round(sum(p * (nb + n / 2)) / (max(tp_all) * max(tn_all)), 9) AS roc_auc, round(sum(p * hits / seen) / max(tp_all), 9) AS average_precision FROM w {group}"""


@query(f"WITH {SCORED_SQL}, base AS (SELECT label, score FROM scored), {ranking_sql('')}")
def ranking_metrics(spark, sf_dir):
    return metrics.ranking_metrics(scored(spark, sf_dir)).select(*fixed(["roc_auc", "average_precision"]))


@query(f"WITH {SCORED_SQL}, base AS (SELECT label, pred AS score FROM scored), {ranking_sql('')}")
def ranking_metrics_hard_labels(spark, sf_dir):
    return metrics.ranking_metrics(scored(spark, sf_dir), score_col="pred").select(*fixed(["roc_auc", "average_precision"]))


@query(f"""WITH {SCORED_SQL}, long AS (SELECT class, unnest([0, 1, 2]) AS cls, unnest([round(1 / (1 + score), 6), round(score / 60, 6), round(abs(score - 15) / 50, 6)]) AS score FROM scored),
base AS (SELECT cls, CAST(class = cls AS INTEGER) AS label, score FROM long), one AS (WITH {ranking_sql('cls')})
SELECT round(avg(roc_auc), 8) AS roc_auc FROM one""")
def one_vs_rest_auc(spark, sf_dir):
    s = F.col("score")
    rows = scored(spark, sf_dir).withColumn("scores", F.array(F.round(1 / (1 + s), 6), F.round(s / 60, 6), F.round(F.abs(s - 15) / 50, 6)))
    return metrics.one_vs_rest_auc(rows, label_col="class").select(F.round("roc_auc", 8).alias("roc_auc"))


@query(f"""WITH {SCORED_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|42'), row_id) - 1) % 5 AS fold FROM scored),
c AS (SELECT fold, {COUNTS_SQL} FROM f GROUP BY fold), m AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c)
SELECT round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std, round(avg(f1), 9) AS f1_mean, round(stddev_pop(f1), 9) AS f1_std FROM m""")
def fold_summary(spark, sf_dir):
    folded = sampling.stratified_folds(scored(spark, sf_dir))
    found = metrics.fold_summary(metrics.binary_metrics(folded, ["fold"]), ["accuracy", "f1"])
    return found.select(*fixed(found.columns))


@query(f"""WITH {VECTORS_SQL}, k AS (SELECT unnest(range(0, (SELECT max(class * 2) + 1 FROM vectors))) AS cls)
SELECT CAST(cls AS INTEGER) AS cls, count(class) AS n FROM k LEFT JOIN vectors ON class * 2 = cls GROUP BY cls""")
def class_distribution(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("label", F.col("class") * 2)
    return metrics.class_distribution(rows)


@query(f"WITH {VECTORS_SQL} SELECT count(*) AS n_samples, max(len(embedding)) AS n_features, count(DISTINCT class) AS n_classes FROM vectors")
def dataset_facts(spark, sf_dir):
    return metrics.dataset_facts(vectors(spark, sf_dir), "class", "embedding")


@query(f"WITH {SCORED_SQL} SELECT count(*) AS num_samples, CAST(sum(pred) AS BIGINT) AS num_anomalies, CAST(count(*) - sum(pred) AS BIGINT) AS num_normal, round(avg(pred), 9) AS anomaly_ratio FROM scored")
def detection_counts(spark, sf_dir):
    return metrics.detection_counts(scored(spark, sf_dir), "pred").withColumn("anomaly_ratio", F.round("anomaly_ratio", 9))


@query(f"""WITH {SCORED_SQL} SELECT round(avg(score), 8) AS score_mean, round(stddev_pop(score), 8) AS score_std, min(score) AS score_min, max(score) AS score_max,
round(quantile_cont(score, 0.5), 8) AS score_median, round(quantile_cont(score, 0.25), 8) AS score_25th, round(quantile_cont(score, 0.75), 8) AS score_75th,
round(quantile_cont(score, 0.95), 8) AS score_95th, round(quantile_cont(score, 0.99), 8) AS score_99th,
round(avg(score) FILTER (WHERE pred = 1), 8) AS score_anomaly_mean, round(avg(score) FILTER (WHERE pred = 0), 8) AS score_normal_mean,
round(avg(score) FILTER (WHERE pred = 1) - avg(score) FILTER (WHERE pred = 0), 8) AS score_separation FROM scored""")
def score_statistics(spark, sf_dir):
    found = metrics.score_statistics(scored(spark, sf_dir), "score", "pred")
    return found.select(*fixed(found.columns, 8))


@query(f"""WITH {VECTORS_SQL}, n AS (SELECT len(embedding) AS d, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS l FROM vectors)
SELECT max(d) AS embedding_dim, round(avg(l), 9) AS embedding_mean_norm, round(stddev_pop(l), 9) AS embedding_std_norm FROM n""")
def embedding_statistics(spark, sf_dir):
    found = metrics.embedding_statistics(vectors(spark, sf_dir))
    return found.select("embedding_dim", *fixed(["embedding_mean_norm", "embedding_std_norm"]))


@query(f"""WITH {SCORED_SQL}, s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|42'), row_id) AS r, count(*) OVER (PARTITION BY label) AS nc, count(*) OVER () AS n FROM scored),
q AS (SELECT label, max(nc) AS nc, max(n) AS n, floor(max(nc) * ceil(0.2 * max(n)) / max(n)) AS b, max(nc) * ceil(0.2 * max(n)) / max(n) - floor(max(nc) * ceil(0.2 * max(n)) / max(n)) AS f FROM s GROUP BY label),
t AS (SELECT label, b + CASE WHEN row_number() OVER (ORDER BY round(f, 9) DESC, label) <= ceil(0.2 * n) - sum(b) OVER () THEN 1 ELSE 0 END AS quota FROM q)
SELECT CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split, count(*) AS samples, round(avg(label), 9) AS anomaly_ratio FROM s JOIN t USING (label) GROUP BY 1""")
def split_summary(spark, sf_dir):
    parts = sampling.stratified_split(scored(spark, sf_dir).select("row_id", "label"))
    return metrics.split_summary(parts).withColumn("anomaly_ratio", F.round("anomaly_ratio", 9))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey > 0 THEN o_totalprice / (o_custkey / 1000.0) ELSE 0 END, 6) AS seconds FROM orders")
def seconds_per_thousand(spark, sf_dir):
    from tracewarden.plans.registry import table
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(metrics.seconds_per_thousand(F.col("o_totalprice"), F.col("o_custkey")), 6).alias("seconds")
    )


# ------------------------------------------------------------------ classifiers


def _cv(spark, sf_dir, name):
    return supervised.evaluate_classifiers_cv(vectors(spark, sf_dir), {name: supervised.CLASSIFIERS[name]})


@query()
def logistic_regression_cv(spark, sf_dir):
    return _cv(spark, sf_dir, "LogReg")


@query()
def decision_tree_cv(spark, sf_dir):
    return _cv(spark, sf_dir, "DecisionTree")


@query()
def random_forest_cv(spark, sf_dir):
    return _cv(spark, sf_dir, "RandomForest")


@query()
def out_of_fold_predictions(spark, sf_dir):
    predictions, _, _ = supervised.out_of_fold(vectors(spark, sf_dir), {"LogReg": supervised.CLASSIFIERS["LogReg"]})
    return predictions


@query()
def embedding_results_cv(spark, sf_dir):
    return supervised.evaluate_embeddings_cv(vectors(spark, sf_dir), "vectors", classifiers={"LogReg": supervised.CLASSIFIERS["LogReg"]})


@query()
def extra_trees_cv(spark, sf_dir):
    return supervised.evaluate_extratrees_cv(loaders.load_unsw_nb15_cleaned(spark, flows(spark, sf_dir)))


@query()
def extra_trees_cv_multi_class(spark, sf_dir):
    coded = loaders.load_unsw_nb15_cleaned(spark, flows(spark, sf_dir), label_col="attack_cat", multi_class=True)
    return supervised.evaluate_extratrees_cv(coded, multi_class=True)


@query()
def evaluation_split(spark, sf_dir):
    return supervised.prepare_evaluation_data(vectors(spark, sf_dir))["summary"]
