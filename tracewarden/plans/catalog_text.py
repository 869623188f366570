"""Queries: batch inference, retrieval and reasoning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewarden.functions import prompts
from tracewarden.functions.text import SPACE
from tracewarden.operators import inference, neighbors, reasoning, retrieval, vector_index
from tracewarden.plans.catalog_rows import fixed
from tracewarden.plans.inputs import ANSWERS_SQL, VECTORS_SQL, answers, vectors
from tracewarden.plans.registry import query, table
from tracewarden.session import scratch_dir, spread

WORDS_SQL = f"""words AS (SELECT doc_id AS row_id, unnest(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda t: t <> '')) AS token FROM documents),
slots AS (SELECT row_id, CAST(('0x' || md5(token)[1:7]) AS BIGINT) % 64 AS j, CASE WHEN CAST(('0x' || md5(token)[8:8]) AS INTEGER) < 8 THEN 1 ELSE -1 END AS s FROM words),
cells AS (SELECT row_id, j, CAST(sum(s) AS DOUBLE) AS v FROM slots GROUP BY 1, 2)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled_sql(template: str, **columns: str) -> str:
    """The SQL expression that fills a prompt template."""
    import re
    pieces = re.split(r"\{(" + "|".join(columns) + r")\}", template)
    return " || ".join(columns[p] if i % 2 else quoted(p) for i, p in enumerate(pieces) if p)


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("line")))


@query(f"""WITH {WORDS_SQL} SELECT row_id, CAST(j AS INTEGER) AS j, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 9) AS x FROM cells WHERE v <> 0""")
def hashing_embedding(spark, sf_dir):
    rows = inference.embed(documents(spark, sf_dir), "line", "hashing")
    return rows.select("row_id", F.posexplode("embedding").alias("j", "x")).where("x <> 0").withColumn("x", F.round("x", 9))


@query("SELECT count(*) AS samples_processed, 64 AS embedding_dim, 0 AS failed FROM documents")
def embedding_metadata(spark, sf_dir):
    return inference.embedding_metadata(inference.embed(documents(spark, sf_dir), "line", "hashing"))


class RefusingBackend(inference.HashingBackend):
    """Refuses texts with a line break, to exercise the fallback."""

    name = "refusing"

    def embed(self, texts):
        if any("\n" in t for t in texts):
            raise ValueError("line break")
        return super().embed(texts)


inference.registry.register("refusing", RefusingBackend, "refuses texts with a line break")


@query("""SELECT doc_id AS row_id, CASE WHEN text LIKE '%' || chr(10) || '%' THEN 2 ELSE 1 END AS backend_attempt, text LIKE '%' || chr(10) || '%' AS fallback_used,
NULL AS error FROM documents""")
def embedding_fallback(spark, sf_dir):
    done = inference.embed_with_fallback(documents(spark, sf_dir), "line", ["refusing", "hashing"])
    return done.select("row_id", "backend_attempt", "fallback_used", "error")


@query("SELECT doc_id AS row_id, CASE WHEN text LIKE '%' || chr(10) || '%' THEN 'ValueError: line break' END AS error, text NOT LIKE '%' || chr(10) || '%' AS has_vector FROM documents")
def embedding_errors(spark, sf_dir):
    done = inference.embed(documents(spark, sf_dir), "line", "refusing")
    return done.select("row_id", "error", F.col("embedding").isNotNull().alias("has_vector"))


@query("""WITH words AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents),
tf AS (SELECT row_id, term, count(*) AS tf FROM words GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT row_id, term, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term))
SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 9) AS weight FROM raw""")
def tfidf_terms(spark, sf_dir):
    return inference.tfidf_terms(documents(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query("""WITH words AS (SELECT DISTINCT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents),
terms AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM words)),
per AS (SELECT row_id, count(*) AS filled, sum(term_id) AS index_sum FROM words JOIN terms USING (term) GROUP BY row_id)
SELECT doc_id AS row_id, (SELECT count(*) FROM terms) AS size, coalesce(filled, 0) AS filled, CAST(coalesce(index_sum, 0) AS BIGINT) AS index_sum,
       CASE WHEN filled > 0 THEN 1.0 ELSE 0.0 END AS squared_length FROM documents LEFT JOIN per ON row_id = doc_id""")
def tfidf_embedding(spark, sf_dir):
    rows = documents(spark, sf_dir)
    done = inference.embed_texts(rows, embedding_type="tfidf", vectorizer=inference.fit_tfidf(rows))
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return done.select(
        "row_id", "embedding.size", F.size("embedding.indices").cast("long").alias("filled"),
        total("embedding.indices", F.lit(0).cast("long")).alias("index_sum"),
        F.round(F.aggregate("embedding.values", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_length"))


# ------------------------------------------------------------------ retrieval

HITS_SQL = """hits AS (SELECT query_id, neighbor_id, rank, distance FROM (
  SELECT a.row_id AS query_id, b.row_id AS neighbor_id, list_distance(a.embedding, b.embedding) AS distance,
         row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.embedding, b.embedding), b.row_id) AS rank
  FROM vectors a, vectors b) WHERE rank <= 3)"""
CONTEXT_SQL = """ctx AS (SELECT query_id, string_agg('Context ' || rank || CASE WHEN label IS NULL THEN '' WHEN label = 0 THEN ' [Normal]' ELSE ' [Anomaly]' END || ': vector ' || neighbor_id || chr(10), '' ORDER BY rank) AS context,
  string_agg(neighbor_id, ',' ORDER BY rank) AS found FROM hits JOIN (SELECT row_id, CASE WHEN class = 3 THEN NULL ELSE label END AS label FROM vectors) v ON v.row_id = neighbor_id GROUP BY query_id)"""


def described(spark, sf_dir):
    """Vectors with a text line; class 3 has no known label."""
    rows = vectors(spark, sf_dir)
    return rows.withColumn("line", F.concat(F.lit("vector "), F.col("row_id").cast("string"))).withColumn(
        "label", F.when(F.col("class") != 3, F.col("label"))
    )


@query(f"WITH {VECTORS_SQL}, {HITS_SQL} SELECT query_id, neighbor_id, rank, round(distance, 9) AS distance FROM hits")
def similarity_search(spark, sf_dir):
    rows = described(spark, sf_dir)
    return retrieval.search(rows, rows).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {VECTORS_SQL}, {HITS_SQL} SELECT query_id, neighbor_id, rank, round(distance, 9) AS distance FROM hits WHERE query_id % 25 = 3""")
def stored_index_search(spark, sf_dir):
    """An index built on half of the vectors, the other half appended, opened anew and searched for every 25th one."""
    rows = described(spark, sf_dir)
    folder = f"{scratch_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    vector_index.build(rows.where("row_id % 2 = 0"), folder, rows_per_cell=100)
    vector_index.append(rows.where("row_id % 2 = 1"), folder)
    return vector_index.search(rows.where("row_id % 25 = 3"), folder).withColumn("distance", F.round("distance", 9))


@query(f"WITH {VECTORS_SQL}, {HITS_SQL} SELECT query_id, neighbor_id, rank, round(distance, 9) AS distance FROM hits WHERE query_id % 100 = 7")
def similarity_search_few(spark, sf_dir):
    """Few queries, which travel to the corpus."""
    rows = described(spark, sf_dir)
    return neighbors.knn_join(rows.where("row_id % 100 = 7"), rows, 3, exclude_self=False, block_rows=50).withColumn("distance", F.round("distance", 9))


@query(f"WITH {VECTORS_SQL}, {HITS_SQL}, {CONTEXT_SQL} SELECT query_id, context, found FROM ctx")
def retrieval_context(spark, sf_dir):
    rows = described(spark, sf_dir)
    found = retrieval.context_text(retrieval.search(rows, rows), rows)
    return found.select("query_id", "context", F.array_join(F.col("retrieved_indices").cast("array<string>"), ",").alias("found"))


@query(f"""WITH {VECTORS_SQL}, {HITS_SQL}, {CONTEXT_SQL} SELECT query_id AS example_idx, 'vector ' || query_id AS query,
{filled_sql(prompts.RETRIEVAL_TRACES, query="'vector ' || query_id", context="context")} AS prompt FROM ctx""")
def retrieval_prompts(spark, sf_dir):
    rows = described(spark, sf_dir)
    context = retrieval.context_text(retrieval.search(rows, rows), rows)
    return retrieval.retrieval_rows(rows, context, "eventtraces").select("example_idx", "query", "prompt")


@query(f"""SELECT conv_id, turn, {filled_sql(prompts.RETRIEVAL_FLOWS, query="text", context="role")} AS flow_prompt,
{filled_sql(prompts.RETRIEVAL_GENERIC, query="text", context="role")} AS generic_prompt FROM conversations""")
def retrieval_prompt_kinds(spark, sf_dir):
    text, role = F.col("text"), F.col("role")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", retrieval.retrieval_prompt(text, role, "unsw-nb15").alias("flow_prompt"),
        retrieval.retrieval_prompt(text, role, "unsw-nb15", structured=False).alias("generic_prompt"),
    )


def span_answers(spark, sf_dir):
    """Answers around a JSON block: complete for the assistant, cut off for the user, none for the system."""
    n = F.length("text").cast("string")
    block = F.concat(
        F.lit('{"critical_spans": [{"start": '), F.col("turn").cast("string"), F.lit(', "end": '), n,
        F.lit(', "severity": 3, "reason": "odd"}, {"start": 2}, {"start": 1, "end": 4}]'),
    )
    tail = F.when(F.col("role") == "assistant", F.concat(block, F.lit("} done"))).when(F.col("role") == "user", block).otherwise("")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("example_idx"), "role", F.col("text").alias("query"),
        F.concat("text", tail).alias("response"), F.array(F.col("turn")).alias("retrieved_indices"),
    )


@query("""WITH a AS (SELECT conv_id * 1000 + turn AS example_idx, turn, text FROM conversations WHERE role = 'assistant')
SELECT example_idx, CAST(turn AS INTEGER) AS start, CAST(length(text) AS INTEGER) AS "end", 3 AS severity, 'odd' AS reason FROM a
UNION ALL SELECT example_idx, 1, 4, 1, NULL FROM a""")
def parse_spans(spark, sf_dir):
    rows = span_answers(spark, sf_dir)
    return rows.select("example_idx", F.explode(retrieval.parse_spans(F.col("response"))).alias("s")).select("example_idx", "s.*")


@query("""SELECT conv_id * 1000 + turn AS example_idx, 1 AS retrieved_count, CASE WHEN role = 'assistant' THEN 2 ELSE 0 END AS spans_detected, 3 AS top_k,
CAST(length(text) + CASE role WHEN 'assistant' THEN length('{"critical_spans": [{"start": ' || turn || ', "end": ' || length(text) || ', "severity": 3, "reason": "odd"}, {"start": 2}, {"start": 1, "end": 4}]} done')
 WHEN 'user' THEN length('{"critical_spans": [{"start": ' || turn || ', "end": ' || length(text) || ', "severity": 3, "reason": "odd"}, {"start": 2}, {"start": 1, "end": 4}]') ELSE 0 END AS INTEGER) AS response_length
FROM conversations""")
def retrieval_results(spark, sf_dir):
    return retrieval.retrieval_results(span_answers(spark, sf_dir)).select(
        "example_idx", "retrieved_count", "spans_detected", "top_k", "response_length"
    )


# ------------------------------------------------------------------ reasoning


@query(f"""WITH {ANSWERS_SQL} SELECT row_id, sample_idx, {filled_sql(prompts.STANDARD_TRACES, entry="line")} AS prompt,
{filled_sql(prompts.STANDARD_FLOWS, entry="line")} AS flow_prompt FROM answers""")
def standard_prompts(spark, sf_dir):
    line = F.col("line")
    return answers(spark, sf_dir).select(
        "row_id", "sample_idx", reasoning.standard_prompt(line, "eventtraces").alias("prompt"),
        reasoning.standard_prompt(line, "unsw-nb15").alias("flow_prompt"),
    )


@query(f"WITH {ANSWERS_SQL} SELECT row_id, sample_idx, CASE WHEN contains(upper(response), 'ANOMALY') THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction, 0.5 AS confidence FROM answers")
def standard_predictions(spark, sf_dir):
    return reasoning.standard_prediction(answers(spark, sf_dir)).select("row_id", "sample_idx", "prediction", "confidence")


def choice(values: list[str]) -> str:
    return "CASE i % 5 " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def varied_sql(template: str, roles: list[str], styles: list[str]) -> str:
    return f"""WITH {ANSWERS_SQL} SELECT row_id AS conv, sample_idx AS turn, i AS sample_idx, {filled_sql(template, role=choice(roles), style=choice(styles), entry="line")} AS prompt
FROM answers, (SELECT CAST(unnest(range(7)) AS INTEGER) AS i)"""


def _varied(spark, sf_dir, kind):
    rows = answers(spark, sf_dir).select(F.col("row_id").alias("conv"), F.col("sample_idx").alias("turn"), "line")
    return reasoning.varied_prompts(rows, kind, 7).select("conv", "turn", "sample_idx", "prompt")


@query(varied_sql(prompts.VARIED_TRACES, prompts.ROLES_TRACES, prompts.STYLES_TRACES))
def varied_prompts(spark, sf_dir):
    return _varied(spark, sf_dir, "eventtraces")


@query(varied_sql(prompts.VARIED_FLOWS, prompts.ROLES_FLOWS, prompts.STYLES_FLOWS))
def varied_flow_prompts(spark, sf_dir):
    return _varied(spark, sf_dir, "unsw-nb15")


VOTE_SQL = f"""{ANSWERS_SQL}, p AS (SELECT row_id, sample_idx, CASE WHEN contains(upper(response), 'ANOMALY') THEN 'ANOMALY' ELSE 'NORMAL' END AS pred FROM answers),
c AS (SELECT row_id, pred, count(*) AS n, min(sample_idx) AS first FROM p GROUP BY 1, 2),
v AS (SELECT row_id, arg_max(pred, n * 1000000 - first) AS prediction, max(n) AS votes, sum(n) AS samples,
 coalesce(max(CASE WHEN pred = 'ANOMALY' THEN n END), 0) AS anomaly_votes FROM c GROUP BY 1)"""


def votes(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("prediction", reasoning.verdict(F.col("response")))
    return reasoning.majority_vote(rows)


@query(f"""WITH {VOTE_SQL} SELECT row_id, prediction, round(votes / samples, 9) AS confidence,
'Majority vote: ' || prediction || ' (' || votes || '/' || CAST(samples AS BIGINT) || ' samples)' AS explanation, round(votes / samples, 9) AS consistency_score, anomaly_votes FROM v""")
def majority_vote(spark, sf_dir):
    return votes(spark, sf_dir).select(
        "row_id", "prediction", "explanation", *fixed(["confidence", "consistency_score"]),
        F.coalesce(F.try_element_at("prediction_distribution", F.lit("ANOMALY")), F.lit(0)).alias("anomaly_votes"),
    )


DECISION_SQL = "CASE WHEN contains(upper(response), 'REJECT') THEN 'REJECT' WHEN contains(upper(response), 'CONFIRM') THEN 'CONFIRM' ELSE 'UNCERTAIN' END"


@query(f"""WITH {ANSWERS_SQL} SELECT row_id, sample_idx, {DECISION_SQL} AS decision,
{filled_sql(prompts.VERIFIER, domain="'network security'", entry="line", prediction="role", explanation="coalesce(nullif(role, 'system'), 'No explanation provided')")} AS prompt FROM answers""")
def verifier_decisions(spark, sf_dir):
    reason = F.when(F.col("role") != "system", F.col("role"))
    return answers(spark, sf_dir).select(
        "row_id", "sample_idx", reasoning.verifier_decision(F.col("response")).alias("decision"),
        reasoning.verifier_prompt(F.col("line"), F.col("role"), reason, "unsw-nb15").alias("prompt"),
    )


def reviewed(spark, sf_dir):
    return answers(spark, sf_dir).select(
        (F.col("row_id") * 1000 + F.col("sample_idx")).alias("row_id"), reasoning.verdict(F.col("response")).alias("prediction"),
        (F.length("line") / 2000.0 + 0.1).alias("confidence"), F.col("role").alias("explanation"),
        reasoning.verifier_decision(F.col("response")).alias("decision"), "line",
    )


@query(f"""WITH {ANSWERS_SQL}, r AS (SELECT row_id * 1000 + sample_idx AS row_id, CASE WHEN contains(upper(response), 'ANOMALY') THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction,
 length(line) / 2000.0 + 0.1 AS c, role, {DECISION_SQL} AS decision, line FROM answers)
SELECT row_id, decision, CASE WHEN decision = 'REJECT' THEN CASE WHEN length(line) > 400 THEN 'ANOMALY' ELSE 'NORMAL' END ELSE prediction END AS verified_prediction,
round(CASE decision WHEN 'REJECT' THEN 0.7 WHEN 'CONFIRM' THEN least(1.0, c + 0.2) ELSE least(1.0, c) END, 9) AS verified_confidence,
CASE WHEN decision = 'REJECT' THEN CASE WHEN length(line) > 400 THEN 'an anomaly' ELSE 'fine' END ELSE 'Verified: ' || role END AS verified_explanation FROM r""")
def verifier_outcome(spark, sf_dir):
    rows = reviewed(spark, sf_dir)
    refined = rows.where(F.col("decision") == "REJECT").select(
        "row_id", F.when(F.length("line") > 400, "an anomaly").otherwise("fine").alias("refined_text")
    )
    done = reasoning.apply_verifier(rows, refined)
    return done.select("row_id", "decision", "verified_prediction", F.round("verified_confidence", 9).alias("verified_confidence"), "verified_explanation")


@query(f"""WITH {ANSWERS_SQL} SELECT row_id, sample_idx,
{filled_sql(prompts.REFINEMENT, entry="line", prediction="role", explanation="coalesce(nullif(role, 'system'), '')", feedback="response")} AS prompt FROM answers""")
def refinement_prompts(spark, sf_dir):
    reason = F.when(F.col("role") != "system", F.col("role"))
    return answers(spark, sf_dir).select(
        "row_id", "sample_idx", reasoning.refinement_prompt(F.col("line"), F.col("role"), reason, F.col("response")).alias("prompt")
    )


@query(f"""WITH {ANSWERS_SQL} SELECT row_id, sample_idx, CASE WHEN role = 'user' THEN 'verifier' WHEN role = 'assistant' THEN 'vote' ELSE 'standard' END AS final_prediction FROM answers""")
def final_verdicts(spark, sf_dir):
    role = F.col("role")
    rows = answers(spark, sf_dir).select(
        "row_id", "sample_idx", F.lit("standard").alias("standard_prediction"),
        F.when(role != "system", "vote").alias("vote_prediction"), F.when(role == "user", "verifier").alias("verifier_prediction"),
    )
    return reasoning.final_verdict(rows).select("row_id", "sample_idx", "final_prediction")


@query(f"""WITH {VOTE_SQL}, rows AS (SELECT DISTINCT conv_id AS row_id FROM conversations)
SELECT row_id, CAST(row_id AS INTEGER) AS sample_index, CAST(row_id > 100 AS INTEGER) AS true_label, prediction, 'hash' AS approach, 'eventtraces' AS dataset_type, 'reasoning_enhancement' AS evaluation_type
FROM rows LEFT JOIN (SELECT * FROM v WHERE samples > 2) v USING (row_id)""")
def labelled_verdicts(spark, sf_dir):
    """Short conversations have no verdict and stay with nulls."""
    rows = answers(spark, sf_dir).select("row_id").distinct().select(
        "row_id", F.col("row_id").cast("int").alias("sample_order"), (F.col("row_id") > 100).cast("int").alias("label")
    )
    held = answers(spark, sf_dir).groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("row_id")
    found = votes(spark, sf_dir).join(held, "row_id", "left_semi").select("row_id", "prediction")
    return reasoning.labelled_results(found, rows, "hash", "eventtraces")


@query(f"""WITH {VOTE_SQL} SELECT v.row_id, v.prediction, CASE WHEN e.vec_id IS NULL THEN 'UNKNOWN' WHEN e.label = 9 THEN 'DETECTED_ANOMALY' ELSE 'DETECTED_NORMAL' END AS anomaly_status,
e.label = 9 AS detected_as_anomaly FROM v LEFT JOIN (SELECT * FROM embeddings WHERE label > 2) e ON e.vec_id = v.row_id""")
def unlabelled_verdicts(spark, sf_dir):
    flags = vectors(spark, sf_dir).where("class > 2").select("row_id", F.col("label").alias("is_anomaly"))
    found = reasoning.unlabelled_results(votes(spark, sf_dir).select("row_id", "prediction"), flags, "hash", "hdfs")
    return found.select("row_id", "prediction", "anomaly_status", "detected_as_anomaly")


@query(f"""WITH {ANSWERS_SQL} SELECT row_id, sample_idx, CASE WHEN regexp_matches(lower(line), 'error|fail|exception|timeout|corrupt') THEN 'ANOMALY' ELSE 'NORMAL' END AS verdict FROM answers""")
def generated_verdicts(spark, sf_dir):
    """Whole records put to the deterministic stand-in."""
    return inference.generate(answers(spark, sf_dir), "line", "rules", out="answer").select(
        "row_id", "sample_idx", reasoning.verdict(F.col("answer")).alias("verdict")
    )
