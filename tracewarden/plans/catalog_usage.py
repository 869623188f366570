"""Queries: resource telemetry, sinks, combined results and whole evaluations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewarden.operators import telemetry
from tracewarden.plans import workflows
from tracewarden.plans.catalog_rows import fixed
from tracewarden.plans.inputs import SAMPLES_SQL, VECTORS_SQL, flows, logs, samples, traces, vectors
from tracewarden.plans.registry import query, table
from tracewarden.session import scratch_dir
from tracewarden.sources import sinks
from tracewarden.streaming.telemetry import rolling_summary

TDP_SQL = """CASE WHEN cpu_name IS NULL THEN 95.0 WHEN contains(lower(cpu_name), 'i9') OR contains(lower(cpu_name), 'ryzen 9') THEN 125.0
WHEN contains(lower(cpu_name), 'i7') OR contains(lower(cpu_name), 'ryzen 7') THEN 95.0 WHEN contains(lower(cpu_name), 'i5') OR contains(lower(cpu_name), 'ryzen 5') THEN 65.0
WHEN contains(lower(cpu_name), 'xeon') OR contains(lower(cpu_name), 'epyc') THEN 150.0 ELSE 95.0 END"""
POWER_SQL = f"""{SAMPLES_SQL}, tdp AS (SELECT *, {TDP_SQL} AS tdp FROM samples),
powered AS (SELECT *, tdp * 0.3 + tdp * 0.7 * (cpu_percent / 100.0) AS estimated_cpu_power,
 CASE WHEN len(list_filter(gpu_power_draw, lambda p: p > 0)) > 0 THEN list_sum(gpu_power_draw)
      WHEN len(gpu_utilization) > 0 THEN list_sum(list_transform(gpu_utilization, lambda u: 250.0 * (u / 100.0))) ELSE 0 END AS estimated_gpu_power FROM tdp),
total AS (SELECT *, 50 + estimated_cpu_power + estimated_gpu_power AS total_estimated_power FROM powered)"""
POWER = ["estimated_cpu_power", "estimated_gpu_power", "total_estimated_power"]


def powered(spark, sf_dir):
    return telemetry.with_power(samples(spark, sf_dir), telemetry.cpu_tdp(F.col("cpu_name")))


@query(f"WITH {POWER_SQL} SELECT row_id, {', '.join(f'round({c}, 9) AS {c}' for c in POWER)} FROM total")
def power_estimates(spark, sf_dir):
    return powered(spark, sf_dir).select("row_id", *fixed(POWER))


@query(f"""WITH {SAMPLES_SQL} SELECT row_id, operation, round(disk_io_read_mb - first_value(disk_io_read_mb) OVER w, 9) AS disk_io_read_mb,
round(network_sent_mb - first_value(network_sent_mb) OVER w, 9) AS network_sent_mb FROM samples WINDOW w AS (PARTITION BY operation ORDER BY timestamp, row_id)""")
def counter_baselines(spark, sf_dir):
    counters = ["disk_io_read_mb", "network_sent_mb"]
    return telemetry.subtract_baseline(samples(spark, sf_dir), counters).select("row_id", "operation", *fixed(counters))


@query(f"""WITH {SAMPLES_SQL} SELECT row_id, CAST(unnest(CASE WHEN len(gpu_utilization) = 0 THEN [NULL] ELSE range(len(gpu_utilization)) END) AS INTEGER) AS gpu,
unnest(CASE WHEN len(gpu_utilization) = 0 THEN [NULL] ELSE gpu_utilization END) AS utilization,
unnest(CASE WHEN len(gpu_utilization) = 0 THEN [NULL] ELSE gpu_memory_used END) AS memory_used,
unnest(CASE WHEN len(gpu_utilization) = 0 THEN [NULL] ELSE gpu_temperature END) AS temperature,
unnest(CASE WHEN len(gpu_utilization) = 0 THEN [NULL] ELSE gpu_power_draw END) AS power_draw FROM samples""")
def gpu_rows(spark, sf_dir):
    return telemetry.gpu_long(samples(spark, sf_dir))


@query(f"""WITH {SAMPLES_SQL} SELECT row_id, operation, gpu_utilization[1] AS gpu_0_utilization, gpu_utilization[2] AS gpu_1_utilization,
gpu_power_draw[1] AS gpu_0_power_draw, gpu_power_draw[2] AS gpu_1_power_draw FROM samples""")
def gpu_columns(spark, sf_dir):
    return telemetry.gpu_wide(samples(spark, sf_dir), 2).select(
        "row_id", "operation", "gpu_0_utilization", "gpu_1_utilization", "gpu_0_power_draw", "gpu_1_power_draw"
    )


def spread_sql(c: str) -> str:
    return f"round(avg({c}), 6) AS {c}_mean, round(max({c}), 6) AS {c}_max, round(min({c}), 6) AS {c}_min, round(stddev_pop({c}), 6) AS {c}_std"


def gpu_sql(i: int) -> str:
    parts = []
    for name, c in (("utilization", "gpu_utilization"), ("memory_used", "gpu_memory_used")):
        parts += [f"round(avg(coalesce({c}[{i + 1}], 0)), 6) AS gpu_{i}_{name}_mean", f"round(max(coalesce({c}[{i + 1}], 0)), 6) AS gpu_{i}_{name}_max"]
    return ", ".join(parts)


@query(f"""WITH {POWER_SQL} SELECT operation, round(max(timestamp) - min(timestamp), 3) AS duration_seconds, count(*) AS sample_count,
round(min(timestamp), 3) AS start_time, round(max(timestamp), 3) AS end_time, {spread_sql('cpu_percent')}, {spread_sql('memory_used_gb')},
{spread_sql('total_estimated_power')}, {gpu_sql(0)}, {gpu_sql(1)} FROM total GROUP BY operation""")
def operation_summary(spark, sf_dir):
    done = telemetry.operation_summary(powered(spark, sf_dir), gpus=2)
    times = ["duration_seconds", "start_time", "end_time"]
    rest = [c for c in done.columns if c not in ("operation", "sample_count", *times)]
    return done.select("operation", "sample_count", *fixed(times, 3), *fixed(rest, 6))


@query(f"""WITH {SAMPLES_SQL}, op AS (SELECT approach, operation, max(timestamp) - min(timestamp) AS d FROM samples GROUP BY 1, 2)
SELECT approach, round(sum(d), 3) AS total_duration, count(*) AS n_operations, round(coalesce(max(d) FILTER (WHERE operation = 'error'), 0), 3) AS error_duration FROM op GROUP BY 1""")
def approach_summary(spark, sf_dir):
    per_op = telemetry.operation_summary(powered(spark, sf_dir), ["approach", "operation"])
    done = telemetry.approach_summary(per_op)
    error = F.coalesce(F.try_element_at("operations", F.lit("error")), F.lit(0.0))
    return done.select("approach", F.round("total_duration", 3).alias("total_duration"), "n_operations", F.round(error, 3).alias("error_duration"))


@query(f"""WITH {POWER_SQL}, op AS (SELECT operation, avg(cpu_percent) AS c, avg(memory_used_gb) AS m, avg(total_estimated_power) AS p, max(timestamp) - min(timestamp) AS d FROM total GROUP BY 1)
SELECT o_orderpriority AS result, o_orderstatus AS operation_code, round(coalesce(c, 0), 6) AS cpu_usage_mean, round(coalesce(m, 0), 6) AS memory_usage_gb_mean,
round(coalesce(p, 0), 6) AS power_consumption_mean_w, round(coalesce(d, 0), 3) AS duration_seconds
FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'view' ELSE 'idle' END AS operation FROM orders) LEFT JOIN op USING (operation)""")
def attach_usage(spark, sf_dir):
    status = F.col("o_orderstatus")
    results = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("result"), status.alias("operation_code"),
        F.when(status == "F", "error").when(status == "O", "view").otherwise("idle").alias("operation"),
    ).distinct()
    done = telemetry.attach_usage(results, telemetry.operation_summary(powered(spark, sf_dir)))
    return done.select(
        "result", "operation_code", *fixed(["cpu_usage_mean", "memory_usage_gb_mean", "power_consumption_mean_w"], 6), *fixed(["duration_seconds"], 3)
    )


@query("""SELECT event_type AS operation, epoch(date_trunc('hour', ts)) AS window_epoch, count(*) AS sample_count, round(avg(least(value, 100.0)), 6) AS cpu_percent_mean
FROM events GROUP BY 1, 2""")
def hourly_operation_summary(spark, sf_dir):
    done = rolling_summary(powered(spark, sf_dir), "1 hour")
    return done.select(
        "operation", F.unix_seconds("window_start").cast("double").alias("window_epoch"), "sample_count",
        F.round("cpu_percent_mean", 6).alias("cpu_percent_mean"),
    )


# ------------------------------------------------------------------ sinks and combined results


def fresh_dir(spark) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query(f"WITH {VECTORS_SQL} SELECT 'model_a' AS approach, count(*) AS n, round(sum(list_sum(embedding)), 6) AS total FROM vectors UNION ALL SELECT 'model_b', count(*), round(2 * sum(list_sum(embedding)), 6) FROM vectors")
def embeddings_sink(spark, sf_dir):
    """Two models' vectors written under one folder and read back."""
    folder = fresh_dir(spark)
    rows = vectors(spark, sf_dir).select("row_id", "embedding")
    sinks.save_embeddings(rows, "model a", folder)
    path = sinks.save_embeddings(rows.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), "model/b", folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).groupBy("approach").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 6).alias("total"))


@query(f"WITH {VECTORS_SQL} SELECT label AS is_anomaly, count(*) AS n, round(sum(embedding[1]), 6) AS total FROM vectors GROUP BY 1")
def anomaly_sink(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = rows.select("row_id", F.col("label").alias("is_anomaly"), F.col("class").cast("double").alias("score"))
    path = sinks.save_anomaly_data(found, rows.select("row_id", "embedding"), "model a", fresh_dir(spark))
    return spark.read.parquet(path).groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("embedding", 0)), 6).alias("total"))


def combined(spark, sf_dir):
    """Result files with different keys: per order, per customer (no eval_type), with a NaN and a nested value."""
    folder = fresh_dir(spark)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("approach"), F.col("o_orderstatus").alias("eval_type"), F.col("o_totalprice").alias("acc"),
        F.lit(float("nan")).alias("f1"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("approach"), F.struct(F.col("c_nationkey").alias("nation")).alias("embedding_metadata")
    )
    sinks.save_results(orders, "results", "orders", folder)
    sinks.save_results(customers, "results", "customers", folder)
    return sinks.combine_results(spark, folder)


@query("""SELECT approach, count(*) AS n FROM (SELECT o_orderpriority AS approach FROM orders UNION ALL SELECT c_mktsegment FROM customer) WHERE approach IS NOT NULL GROUP BY 1""")
def combined_results_by_approach(spark, sf_dir):
    return sinks.value_counts(combined(spark, sf_dir), "approach")


@query("SELECT o_orderstatus AS eval_type, count(*) AS n FROM orders GROUP BY 1")
def combined_results_by_type(spark, sf_dir):
    return sinks.value_counts(combined(spark, sf_dir), "eval_type")


# ------------------------------------------------------------------ whole evaluations


def quick() -> workflows.Settings:
    from tracewarden.operators.supervised import CLASSIFIERS
    return workflows.Settings(classifiers={"LogReg": CLASSIFIERS["LogReg"]})


@query()
def labelled_evaluation(spark, sf_dir):
    return workflows.run_standard(spark, traces(spark, sf_dir), "hashing", settings=quick()).results


@query()
def labelled_evaluation_reasoning(spark, sf_dir):
    done = workflows.run_standard(spark, traces(spark, sf_dir), "hashing", settings=quick()).reasoning
    return done.select("row_id", "sample_index", "true_label", "standard_prediction", "vote_prediction", "decision", "final_prediction")


@query()
def flow_pair_evaluation(spark, sf_dir):
    """Customers' and suppliers' balances as the train and test flow files."""
    def as_flows(df, prefix):
        balance = F.col(f"{prefix}_acctbal")
        return df.select(
            F.col(df.columns[0]).alias("row_id"), F.substring(f"{prefix}_name", 1, 4).alias("proto"), F.col(f"{prefix}_nationkey").alias("ct"),
            balance.alias("spkts"), (balance > 5000).cast("int").alias("label"),
        )
    train = as_flows(table(spark, sf_dir, "customer"), "c")
    test = as_flows(table(spark, sf_dir, "supplier"), "s")
    return workflows.run_flow_pair(spark, train, test, "hashing", settings=quick()).results


@query()
def unlabelled_evaluation(spark, sf_dir):
    """Conversation turns as log lines."""
    lines = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("Component"), F.col("text").alias("Content")
    )
    return workflows.run_unlabelled(spark, lines, "hashing", settings=quick()).results


@query()
def model_comparison(spark, sf_dir):
    """Two embedding backends, one of which cannot be built; its error row stays in the combined table."""
    def broken():
        raise RuntimeError("model not available")
    lines = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("Component"), F.col("text").alias("Content")
    )
    return workflows.run_models(
        workflows.run_unlabelled, spark, {"hashing": "hashing", "broken": broken}, fresh_dir(spark), source=lines, options={"reasoning": False},
    ).select("approach", "dataset_type", "error", "total_samples")
