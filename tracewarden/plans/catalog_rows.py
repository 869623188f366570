"""Queries: readers, row preparation, sampling and splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewarden.functions import arrays, text
from tracewarden.operators import encoding, sampling
from tracewarden.plans.inputs import (
    FLOWS_SQL, LOGS_SQL, TRACES_SQL, VECTORS_SQL, flows, logs, traces, vectors,
)
from tracewarden.plans.registry import ORACLES, query, table
from tracewarden.session import scratch_dir
from tracewarden.sources import loaders

# White space for the SQL twins; the same class the library strips.
WS = text.SPACE
STRIP = f"'^{WS}+|{WS}+$'"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, {STRIP}, '', 'g')"


def fixed(columns: list[str], digits: int = 9) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


# ------------------------------------------------------------------ event traces


@query(f"""WITH {TRACES_SQL}, raw AS (SELECT row_id, label, {strip_sql('features')} AS f FROM traces WHERE label IS NOT NULL),
body AS (SELECT row_id, label, CASE WHEN f LIKE '[%' AND f LIKE '%]' THEN substr(f, 2, length(f) - 2) ELSE f END AS b FROM raw),
tok AS (SELECT row_id, label, list_filter(list_transform(string_split(b, ','), lambda t: {strip_sql('t')}), lambda t: t <> '') AS t FROM body)
SELECT row_id, array_to_string(t, ' ') AS line, CASE WHEN label IN ('Success', 'Normal') THEN 0 ELSE 1 END AS label
FROM tok WHERE len(t) > 0""")
def load_event_traces(spark, sf_dir):
    return loaders.load_event_traces(spark, traces(spark, sf_dir))


@query(f"""WITH {TRACES_SQL}, tok AS (
  SELECT row_id, label, list_filter(regexp_split_to_array(regexp_replace(features, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), '{WS}+'), lambda t: t <> '') AS t
  FROM traces WHERE label IS NOT NULL)
SELECT row_id, array_to_string(t, ' ') AS line, CASE WHEN label IN ('Success', 'Normal') THEN 0 ELSE 1 END AS label
FROM tok WHERE len(t) > 0""")
def load_event_traces_raw(spark, sf_dir):
    return loaders.load_event_traces(spark, traces(spark, sf_dir), preprocessing={"parse_features": False})


@query(f"""WITH {TRACES_SQL} SELECT row_id, CASE WHEN label IS NULL THEN 0 WHEN label IN ('Success', 'Normal') THEN 0 ELSE 1 END AS label,
 length(features) > 2 AS has_text FROM traces""")
def trace_labels(spark, sf_dir):
    return traces(spark, sf_dir).select(
        "row_id", text.trace_label(F.col("Label")).alias("label"), (F.length("Features") > 2).alias("has_text")
    )


@query(f"""WITH {LOGS_SQL} SELECT row_id, concat_ws(' ', date_, time_, level_, component_, content_) AS line, row_id AS line_id,
 substr(component_, 5) AS event_id FROM logs""")
def load_hdfs_unlabeled(spark, sf_dir):
    return loaders.load_dataset_unlabeled(spark, logs(spark, sf_dir), "hdfs").select(
        "row_id", "line", F.col("LineId").alias("line_id"), F.col("EventId").alias("event_id")
    )


@query(f"""WITH {LOGS_SQL} SELECT row_id, concat_ws(' ', date_, time_, level_, component_, content_) AS line
 FROM logs ORDER BY row_id LIMIT 500""")
def load_hdfs_first_lines(spark, sf_dir):
    return loaders.load_hdfs_unlabeled(spark, logs(spark, sf_dir), nlines=500).select("row_id", "line")


TEMPLATES_SQL = f"""templates AS (
  SELECT 'E' || p_partkey AS event_id, {strip_sql(f"regexp_replace(replace('[*]' || replace(p_name, ' ', '[*]  ') || '[*]', '[*]', ''), '{WS}+', ' ', 'g')")} AS template
  FROM part)"""


def part_templates(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("EventId"),
        F.concat(F.lit("[*]"), F.replace("p_name", F.lit(" "), F.lit("[*]  ")), F.lit("[*]")).alias("EventTemplate"),
    )
    return loaders.load_log_templates(spark, raw)


@query(f"WITH {TEMPLATES_SQL} SELECT event_id, template FROM templates")
def load_log_templates(spark, sf_dir):
    return part_templates(spark, sf_dir).select(F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template"))


@query(f"""WITH {TEMPLATES_SQL} SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id,
 coalesce(a.template, 'E' || l_partkey) || ' ' || coalesce(b.template, 'E' || l_suppkey) || ' ' || l_returnflag AS line
 FROM lineitem LEFT JOIN templates a ON a.event_id = 'E' || l_partkey LEFT JOIN templates b ON b.event_id = 'E' || l_suppkey""")
def enrich_with_templates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        F.concat(F.lit("E"), F.col("l_partkey").cast("string"), F.lit(" E"), F.col("l_suppkey").cast("string"), F.lit(" "), F.col("l_returnflag")).alias("line"),
    )
    return encoding.enrich_tokens(lines, "line", part_templates(spark, sf_dir))


@query("""WITH t AS (SELECT 'E' || n_nationkey AS event_id, lower(n_name) AS template FROM nation)
SELECT c_custkey AS row_id, coalesce(a.template, 'E' || c_nationkey) || ' ' || c_mktsegment || ' ' || coalesce(b.template, 'E' || c_custkey) AS line
FROM customer LEFT JOIN t a ON a.event_id = 'E' || c_nationkey LEFT JOIN t b ON b.event_id = 'E' || c_custkey""")
def enrich_with_small_templates(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("E"), F.col("n_nationkey").cast("string")).alias("EventId"), F.lower("n_name").alias("EventTemplate")
    )
    lines = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.concat(F.lit("E"), F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_mktsegment"), F.lit(" E"), F.col("c_custkey").cast("string")).alias("line"),
    )
    return encoding.enrich_tokens(lines, "line", known)


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN NULL WHEN 'click' THEN NULL ELSE event_type END AS word
FROM events""")
def null_words(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", "NA").when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "null").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.null_if_missing(raw).alias("word"))


# ------------------------------------------------------------------ flows

CODES_SQL = """codes AS (SELECT row_id, label, attack_cat, spkts, sbytes, rate, ct,
  dense_rank() OVER (ORDER BY coalesce(proto, '{null}')) - 1 AS proto, dense_rank() OVER (ORDER BY coalesce(service, '{null}')) - 1 AS service,
  dense_rank() OVER (ORDER BY coalesce(state, '{null}')) - 1 AS state FROM flows)"""


def dbl(expr: str) -> str:
    return f"CAST(CAST({expr} AS DOUBLE) AS VARCHAR)"


@query(f"""WITH {FLOWS_SQL}, {CODES_SQL.format(null='unknown')}
SELECT row_id, concat_ws(' ', {', '.join(dbl(c) for c in ('proto', 'service', 'state', 'spkts', 'sbytes', 'rate', 'ct'))}) AS line, label FROM codes""")
def load_flows_as_text(spark, sf_dir):
    return loaders.load_dataset(spark, flows(spark, sf_dir), "unsw-nb15")


FEATURES = ["proto", "service", "state", "spkts", "sbytes", "rate", "ct"]


def scaled_sql(null: str, label: str) -> str:
    cols = ", ".join(
        f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE (CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 9) AS {c}"
        for c in FEATURES
    )
    return f"WITH {FLOWS_SQL}, {CODES_SQL.format(null=null)} SELECT row_id, {label}{cols} FROM codes"


def wide(df, keep):
    return df.select(*keep, *[F.round(F.get("features", i), 9).alias(c) for i, c in enumerate(FEATURES)])


@query(scaled_sql("nan", "label, "))
def load_flow_features(spark, sf_dir):
    return wide(loaders.load_unsw_nb15_cleaned(spark, flows(spark, sf_dir)), ["row_id", "label"])


@query(scaled_sql("nan", "CAST(dense_rank() OVER (ORDER BY attack_cat) - 1 AS INTEGER) AS label, "))
def load_flow_features_multi_class(spark, sf_dir):
    coded = loaders.load_unsw_nb15_cleaned(spark, flows(spark, sf_dir), label_col="attack_cat", multi_class=True)
    return wide(coded, ["row_id", "label"])


@query(scaled_sql("nan", """(SELECT concat_ws(' ', proto, service, coalesce(state, 'nan'), CAST(spkts AS VARCHAR), CAST(sbytes AS VARCHAR), CAST(rate AS VARCHAR), ct)
 FROM flows f WHERE f.row_id = codes.row_id) AS line, """))
def load_flows_unlabelled(spark, sf_dir):
    return wide(loaders.load_dataset_unlabeled(spark, flows(spark, sf_dir), "unsw-nb15"), ["row_id", "line"])


# ------------------------------------------------------------------ the same through CSV files


def csv_copy(spark, rows):
    """The rows written as CSV text with a header and read back, every type found anew."""
    path = f"{scratch_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


@query(ORACLES["load_flows_as_text"])
def csv_flows_as_text(spark, sf_dir):
    rows = loaders.read_csv(spark, csv_copy(spark, flows(spark, sf_dir)), id_col="row_id", infer_types=True)
    return loaders.load_dataset(spark, rows, "unsw-nb15")


@query(ORACLES["load_flow_features"])
def csv_flow_features(spark, sf_dir):
    rows = loaders.read_csv(spark, csv_copy(spark, flows(spark, sf_dir)), id_col="row_id", infer_types=True)
    return wide(loaders.load_unsw_nb15_cleaned(spark, rows), ["row_id", "label"])


@query(ORACLES["load_flows_unlabelled"])
def csv_flows_unlabelled(spark, sf_dir):
    rows = loaders.read_csv(spark, csv_copy(spark, flows(spark, sf_dir)), id_col="row_id", infer_types=True)
    return wide(loaders.load_dataset_unlabeled(spark, rows, "unsw-nb15"), ["row_id", "line"])


@query(ORACLES["load_hdfs_unlabeled"])
def csv_hdfs_unlabeled(spark, sf_dir):
    rows = loaders.read_csv(spark, csv_copy(spark, logs(spark, sf_dir).drop("row_id")), id_col="LineId")
    return loaders.load_dataset_unlabeled(spark, rows, "hdfs").select(
        "row_id", "line", F.col("LineId").cast("long").alias("line_id"), F.col("EventId").alias("event_id"))


@query(f"WITH {FLOWS_SQL} SELECT DISTINCT coalesce(state, 'unknown') AS value, CAST(dense_rank() OVER (ORDER BY coalesce(state, 'unknown')) - 1 AS INTEGER) AS code FROM flows")
def category_codes(spark, sf_dir):
    return encoding.category_codes(flows(spark, sf_dir), ["state"], "unknown").select("value", "code")


@query("""SELECT DISTINCT 'p_name' AS column_name, p_name AS value, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code FROM part
UNION ALL SELECT DISTINCT 'p_type', p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) FROM part""")
def category_codes_many_columns(spark, sf_dir):
    return encoding.category_codes(table(spark, sf_dir, "part"), ["p_name", "p_type"], "nan")


@query("""SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS c_acctbal,
0.0 AS same FROM customer""")
def min_max_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(7).alias("same"))
    return encoding.min_max_scale(rows, ["c_acctbal", "same"]).select("c_custkey", *fixed(["c_acctbal", "same"]))


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 0.0 WHEN event_type = 'click' THEN value * 1000 ELSE value END AS number
FROM events""")
def numeric_coercion(spark, sf_dir):
    v = F.col("value").cast("string")
    raw = (
        F.when(F.col("event_type") == "error", F.concat(v, F.lit("x"))).when(F.col("event_type") == "view", F.lit(None))
        .when(F.col("event_type") == "click", F.concat(F.lit(" "), v, F.lit("e3 "))).otherwise(v)
    )
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", text.to_number(F.col("raw"), rows.schema["raw"].dataType).alias("number"))


@query("""SELECT event_id, CAST(value AS VARCHAR) AS plain, CAST(value / 1e6 AS VARCHAR) AS small, CAST(value * 1e7 / 3 AS VARCHAR) AS large,
CAST(value * 1e18 AS VARCHAR) AS huge FROM events""")
def float_text(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", text.float_text(v).alias("plain"), text.float_text(v / 1e6).alias("small"),
        text.float_text(v * 1e7 / 3).alias("large"), text.float_text(v * 1e18).alias("huge"),
    )


@query("SELECT concat_ws(' ', o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR)) AS line FROM orders")
def render_rows(spark, sf_dir):
    rows = encoding.drop_present(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority", "absent"])
    return rows.select(text.render_row(rows, rows.columns, unify_numbers=False).alias("line"))


@query(f"WITH {FLOWS_SQL} SELECT row_id, CAST(attack_cat IS DISTINCT FROM 'Normal' AS INTEGER) AS label FROM flows")
def label_from_category(spark, sf_dir):
    rows, _ = loaders.flow_label(flows(spark, sf_dir).drop("label"))
    return rows.select("row_id", F.col("_label").alias("label"))


@query("SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def drop_duplicate_rows(spark, sf_dir):
    return sampling.drop_duplicate_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")


# ------------------------------------------------------------------ vectors as data


@query("""WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN v < -0.2 OR v > 0.2 THEN 0 ELSE v END) AS e FROM embeddings)
SELECT vec_id, len(list_filter(e, lambda v: v = 0)) AS zeros, round(list_sum(e), 9) AS total FROM x""")
def clean_vectors(spark, sf_dir):
    broken = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v < -0.2, float("nan")).when(v > 0.2, float("inf")).otherwise(v))
    e = table(spark, sf_dir, "embeddings").select("vec_id", arrays.clean_vector(broken).alias("e"))
    return e.select(
        "vec_id", F.size(F.filter("e", lambda v: v == 0)).cast("long").alias("zeros"),
        F.round(F.aggregate("e", F.lit(0.0), lambda a, v: a + v), 9).alias("total"),
    )


@query("""SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])[1:16]), 9) AS cut, round(list_sum(CAST(embedding AS DOUBLE[])), 9) AS padded,
80 AS padded_size FROM embeddings""")
def resize_vectors(spark, sf_dir):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 9)
    padded = arrays.resize_vector(F.col("embedding"), 80)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", total(arrays.resize_vector(F.col("embedding"), 16)).alias("cut"), total(padded).alias("padded"),
        F.size(padded).alias("padded_size"),
    )


@query(f"""WITH {VECTORS_SQL} SELECT CASE WHEN class < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS anomalies
FROM vectors GROUP BY 1""")
def union_parts(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    both = sampling.union_parts(rows.where("class < 8"), rows.where("class >= 8"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("anomalies"))


# ------------------------------------------------------------------ sampling and splitting


@query("SELECT * FROM (SELECT event_id AS row_id, event_type, value FROM events) ORDER BY md5(row_id || '|42'), row_id LIMIT 1000")
def seeded_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "event_type", "value")
    return sampling.seeded_sample(rows, 1000)


@query(f"WITH {FLOWS_SQL} SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42'), row_id) - 1 AS rank FROM flows")
def hash_rank(spark, sf_dir):
    return sampling.hash_rank(flows(spark, sf_dir).select("row_id"))


LABELLED_SQL = "ev AS (SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS label, value FROM events)"


def labelled_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), (F.col("event_type") == "error").cast("int").alias("label"), "value"
    )


@query(f"""WITH {LABELLED_SQL}, sizes AS (SELECT label, count(*) AS nc, sum(count(*)) OVER () AS n FROM ev GROUP BY label),
share AS (SELECT label, ceil(0.2 * n) AS nt, nc * ceil(0.2 * n) / n AS s, floor(nc * ceil(0.2 * n) / n) AS b FROM sizes),
quota AS (SELECT label, b + CASE WHEN row_number() OVER (ORDER BY round(s - b, 9) DESC, label) <= nt - sum(b) OVER () THEN 1 ELSE 0 END AS q FROM share),
ranked AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|42'), row_id) - 1 AS r FROM ev)
SELECT row_id, label, CASE WHEN r < q THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quota USING (label)""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(labelled_events(spark, sf_dir).select("row_id", "label"))


@query(f"""WITH {LABELLED_SQL} SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|42'), row_id) - 1) % 5 AS INTEGER) AS fold FROM ev""")
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(labelled_events(spark, sf_dir).select("row_id", "label"))


@query(f"WITH {LABELLED_SQL} SELECT label, count(*) AS n_class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM ev GROUP BY label")
def class_weights(spark, sf_dir):
    return sampling.class_weights(labelled_events(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query("""SELECT user_id, ta AS total_anomalies, tn AS total_normals,
CAST(least(least(8, greatest(3, greatest(1, floor(ta * 0.1)))), ta) AS BIGINT) AS anomaly_samples, least(2, tn) AS normal_samples
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS ta, count(*) FILTER (WHERE event_type <> 'error') AS tn FROM events GROUP BY user_id)""")
def reasoning_sample_sizes(spark, sf_dir):
    totals = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("total_anomalies"), F.count_if(F.col("event_type") != "error").alias("total_normals")
    )
    return sampling.reasoning_sample_sizes(totals, anomaly_percentage=0.1)


@query(f"""WITH {LABELLED_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS p,
 count(*) OVER (PARTITION BY label) AS n FROM ev)
SELECT row_id, label, value FROM placed WHERE (label = 1 AND p <= least(least(8, greatest(3, greatest(1, floor(n * 0.1)))), n)) OR (label = 0 AND p <= 2)""")
def pick_reasoning_rows(spark, sf_dir):
    return sampling.pick_reasoning_rows(labelled_events(spark, sf_dir), anomaly_percentage=0.1).select("row_id", "label", "value")
