"""The tables in the roles the operators expect: traces, flows, log lines, vectors, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.plans.registry import table

TRACES_SQL = """traces AS (
  SELECT d.doc_id AS row_id, '[' || replace(d.text, ' ', ', ') || ']' AS features,
         CASE WHEN l.quality = 1 THEN 'Success' WHEN l.quality = 0 THEN 'Fail' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bracketed event lists; only some have a label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    word = F.when(F.col("quality") == 1, "Success").when(F.col("quality") == 0, "Fail")
    return docs.select("doc_id", "text").join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("["), F.replace("text", F.lit(" "), F.lit(", ")), F.lit("]")).alias("Features"), word.alias("Label"),
    )


FLOWS_SQL = """flows AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_orderkey AS id, l_suppkey AS sttl,
         l_returnflag AS proto, l_linestatus AS service,
         CASE WHEN l_quantity >= 5 THEN l_returnflag || l_linestatus END AS state,
         l_quantity AS spkts, l_extendedprice AS sbytes, l_tax AS rate, l_linenumber AS ct,
         CAST(l_discount >= 0.09 AS INTEGER) AS label,
         CASE WHEN l_discount < 0.09 THEN 'Normal' WHEN l_discount < 0.1 THEN 'DoS' ELSE 'Exploits' END AS attack_cat
  FROM lineitem)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as network flows with categories, numbers and both label columns."""
    discount = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("sttl"), F.col("l_returnflag").alias("proto"),
        F.col("l_linestatus").alias("service"),
        F.when(F.col("l_quantity") >= 5, F.concat("l_returnflag", "l_linestatus")).alias("state"),
        F.col("l_quantity").alias("spkts"), F.col("l_extendedprice").alias("sbytes"), F.col("l_tax").alias("rate"),
        F.col("l_linenumber").alias("ct"), (discount >= 0.09).cast("int").alias("label"),
        F.when(discount < 0.09, "Normal").when(discount < 0.1, "DoS").otherwise("Exploits").alias("attack_cat"),
    )


LOGS_SQL = """logs AS (
  SELECT event_id AS row_id, strftime(ts, '%y%m%d') AS date_, strftime(ts, '%H%M%S') AS time_,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN NULL ELSE 'INFO' END AS level_,
         'svc.' || event_type AS component_, props AS content_
  FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as structured log lines; views carry no level."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", F.lit(None)).otherwise("INFO")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.date_format("ts", "yyMMdd").alias("Date"), F.date_format("ts", "HHmmss").alias("Time"),
        level.alias("Level"), F.concat(F.lit("svc."), "event_type").alias("Component"), F.col("props").alias("Content"),
        F.col("event_id").alias("LineId"), F.col("event_type").alias("EventId"),
    )


VECTORS_SQL = """vectors AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS embedding, label AS class, CAST(label = 9 AS INTEGER) AS label
  FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as doubles, class 9 being the anomaly."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("class"), (F.col("label") == 9).cast("int").alias("label"),
    )


PLANE_SQL = """points AS (
  SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two vector entries as two-entry vectors."""
    return vectors(spark, sf_dir).select("row_id", F.slice("embedding", 1, 2).alias("embedding"))


SCORED_SQL = """scored AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, CAST(l_discount >= 0.09 AS INTEGER) AS label,
         CAST(l_tax >= 0.07 AS INTEGER) AS pred, round(l_quantity * (0.5 + l_discount), 2) AS score,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class,
         CASE WHEN l_tax < 0.03 THEN 0 WHEN l_tax < 0.06 THEN 1 ELSE 2 END AS class_pred, l_linestatus AS model
  FROM lineitem)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a prediction table: binary and three-class, with a score that has many ties."""
    flag, tax = F.col("l_returnflag"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        (F.col("l_discount") >= 0.09).cast("int").alias("label"), (tax >= 0.07).cast("int").alias("pred"),
        F.round(F.col("l_quantity") * (0.5 + F.col("l_discount")), 2).alias("score"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("class"),
        F.when(tax < 0.03, 0).when(tax < 0.06, 1).otherwise(2).alias("class_pred"), F.col("l_linestatus").alias("model"),
    )


SAMPLES_SQL = """samples AS (
  SELECT event_id AS row_id, event_type AS operation, 'user-' || user_id AS approach, epoch(ts) AS timestamp,
         least(value, 100.0) AS cpu_percent, value / 10.0 AS memory_used_gb,
         CASE WHEN user_id < 50 THEN [] WHEN user_id < 100 THEN [least(value, 100.0)] ELSE [least(value, 100.0), 40.0] END AS gpu_utilization,
         CASE WHEN user_id < 50 THEN [] WHEN user_id < 100 THEN [value / 20.0] ELSE [value / 20.0, 2.0] END AS gpu_memory_used,
         CASE WHEN user_id < 50 THEN [] WHEN user_id < 100 THEN [55.0] ELSE [55.0, 60.0] END AS gpu_temperature,
         CASE WHEN user_id < 50 THEN [] WHEN user_id < 100 THEN [0.0] ELSE [0.0, value] END AS gpu_power_draw,
         value * 2.0 AS disk_io_read_mb, value * 3.0 AS network_sent_mb,
         CASE event_type WHEN 'error' THEN 'Intel(R) Core(TM) i9' WHEN 'view' THEN 'AMD Ryzen 5 5600' WHEN 'click' THEN 'AMD EPYC 7763'
              WHEN 'signup' THEN NULL ELSE 'Apple M2' END AS cpu_name
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as resource samples: none, one or two GPUs by user."""
    value, user = F.col("value"), F.col("user_id")
    busy = F.least(value, F.lit(100.0))

    def gpus(one, two):
        return F.when(user < 50, F.array().cast("array<double>")).when(user < 100, F.array(one)).otherwise(F.array(one, two))

    name = (
        F.when(F.col("event_type") == "error", "Intel(R) Core(TM) i9").when(F.col("event_type") == "view", "AMD Ryzen 5 5600")
        .when(F.col("event_type") == "click", "AMD EPYC 7763").when(F.col("event_type") == "signup", F.lit(None)).otherwise("Apple M2")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("operation"),
        F.concat(F.lit("user-"), user.cast("string")).alias("approach"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        busy.alias("cpu_percent"), (value / 10.0).alias("memory_used_gb"), gpus(busy, F.lit(40.0)).alias("gpu_utilization"),
        gpus(value / 20.0, F.lit(2.0)).alias("gpu_memory_used"), gpus(F.lit(55.0), F.lit(60.0)).alias("gpu_temperature"),
        gpus(F.lit(0.0), value).alias("gpu_power_draw"), (value * 2.0).alias("disk_io_read_mb"),
        (value * 3.0).alias("network_sent_mb"), name.alias("cpu_name"),
    )


ANSWERS_SQL = """answers AS (
  SELECT conv_id AS row_id, turn AS sample_idx, role, text AS line,
         text || CASE role WHEN 'user' THEN ' looks like an Anomaly, I REJECT it' WHEN 'assistant' THEN ' all normal: confirm' ELSE '' END AS response
  FROM conversations)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as sampled answers with a verdict word added by role."""
    word = (
        F.when(F.col("role") == "user", " looks like an Anomaly, I REJECT it").when(F.col("role") == "assistant", " all normal: confirm").otherwise("")
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("row_id"), F.col("turn").alias("sample_idx"), "role", F.col("text").alias("line"),
        F.concat("text", word).alias("response"),
    )
