"""Resource samples: counter baselines, the power model and roll-ups per operation and approach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The power model.
BASELINE_WATTS = 50.0
IDLE_SHARE = 0.3
ACTIVE_SHARE = 0.7
GPU_WATTS = 250.0
DEFAULT_TDP = 95.0
TDP_BY_NAME = [
    (("i9", "ryzen 9"), 125.0),
    (("i7", "ryzen 7"), 95.0),
    (("i5", "ryzen 5"), 65.0),
    (("xeon", "epyc"), 150.0),
]
GPU_ARRAYS = {
    "utilization": "gpu_utilization", "memory_used": "gpu_memory_used", "temperature": "gpu_temperature",
    "power_draw": "gpu_power_draw",
}


def cpu_tdp(name: Column) -> Column:
    """Design power by processor name, first match wins."""
    lowered = F.lower(name)
    out = F.when(name.isNull(), F.lit(DEFAULT_TDP))
    for words, watts in TDP_BY_NAME:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        out = out.when(hit, F.lit(watts))
    return out.otherwise(F.lit(DEFAULT_TDP))


def with_power(df: DataFrame, tdp: Column | float = DEFAULT_TDP) -> DataFrame:
    """Estimated CPU, GPU and total power of each sample."""
    watts = F.lit(tdp) if isinstance(tdp, float) else tdp
    cpu = watts * IDLE_SHARE + watts * ACTIVE_SHARE * (F.col("cpu_percent") / 100.0)
    measured = F.col("gpu_power_draw")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    gpu = (
        F.when(F.exists(measured, lambda p: p > 0), total(measured))
        .when(F.size("gpu_utilization") > 0, total(F.transform("gpu_utilization", lambda u: GPU_WATTS * (u / 100.0))))
        .otherwise(F.lit(0.0))
    )
    return (
        df.withColumn("estimated_cpu_power", cpu).withColumn("estimated_gpu_power", gpu)
        .withColumn("total_estimated_power", F.lit(BASELINE_WATTS) + F.col("estimated_cpu_power") + F.col("estimated_gpu_power"))
    )


def subtract_baseline(df: DataFrame, counters: list[str], by: str = "operation", time_col: str = "timestamp", id_col: str = "row_id") -> DataFrame:
    """G1: counters relative to the first sample of their operation.

    The first sample is found by a partial aggregate and joined back, so a long operation is never
    sorted in one task; the small side is one row per operation.
    """
    first = df.groupBy(by).agg(*[
        F.min_by(c, F.struct(time_col, id_col)).alias(f"_base_{c}") for c in counters
    ])
    joined = df.join(first, by)
    return joined.select(*[(F.col(c) - F.col(f"_base_{c}")).alias(c) if c in counters else F.col(c) for c in df.columns])


def gpu_long(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row per sample and GPU index."""
    zipped = F.arrays_zip(*[F.col(c).alias(name) for name, c in GPU_ARRAYS.items()])
    return df.select(id_col, F.posexplode_outer(zipped).alias("gpu", "_g")).select(
        id_col, "gpu", *[F.col("_g")[name].alias(name) for name in GPU_ARRAYS]
    )


def gpu_wide(df: DataFrame, gpu_count: int) -> DataFrame:
    """``gpu_<i>_<measure>`` columns instead of the arrays, for CSV output."""
    flat = [F.get(F.col(c), i).alias(f"gpu_{i}_{name}") for name, c in GPU_ARRAYS.items() for i in range(gpu_count)]
    return df.select(*[c for c in df.columns if c not in (*GPU_ARRAYS.values(), "gpu_memory_total")], *flat)


def _spread(name: str) -> list[Column]:
    return [
        F.avg(name).alias(f"{name}_mean"), F.max(name).alias(f"{name}_max"), F.min(name).alias(f"{name}_min"),
        F.stddev_pop(name).alias(f"{name}_std"),
    ]


def operation_summary(samples: DataFrame, by: list[str] | None = None, gpus: int = 0) -> DataFrame:
    """Duration, sample count and spread of CPU, memory and power per operation."""
    per_gpu = []
    for i in range(gpus):
        for name in ("utilization", "memory_used"):
            value = F.coalesce(F.get(F.col(GPU_ARRAYS[name]), i), F.lit(0.0))
            per_gpu += [F.avg(value).alias(f"gpu_{i}_{name}_mean"), F.max(value).alias(f"gpu_{i}_{name}_max")]
    return samples.groupBy(*(by or ["operation"])).agg(
        (F.max("timestamp") - F.min("timestamp")).alias("duration_seconds"), F.count(F.lit(1)).alias("sample_count"),
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        *_spread("cpu_percent"), *_spread("memory_used_gb"), *_spread("total_estimated_power"), *per_gpu,
    )


def approach_summary(operations: DataFrame) -> DataFrame:
    """All operations of an approach in one map, and their durations added up.

    The input has one row per operation of an approach, so the map is small.
    """
    return operations.groupBy("approach").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("operation", "duration_seconds")))).alias("operations"),
        F.sum("duration_seconds").alias("total_duration"), F.count(F.lit(1)).alias("n_operations"),
    )


def attach_usage(results: DataFrame, operations: DataFrame, key: str = "operation") -> DataFrame:
    """Resource means next to each result row, 0 where nothing was measured."""
    usage = operations.select(
        key, F.col("cpu_percent_mean").alias("cpu_usage_mean"), F.col("memory_used_gb_mean").alias("memory_usage_gb_mean"),
        F.col("total_estimated_power_mean").alias("power_consumption_mean_w"), "duration_seconds",
    )
    names = ["cpu_usage_mean", "memory_usage_gb_mean", "power_consumption_mean_w", "duration_seconds"]
    return results.join(usage, key, "left").na.fill(0.0, names)
