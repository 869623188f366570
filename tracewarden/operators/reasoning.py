"""Verdict tables: prompts, majority vote, verifier and the final verdict.

A verdict table has one row per (row_id, sample_idx) with the answer text; every step after the
answers is aggregation and ``case`` logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import prompts


def verdict(text: Column) -> Column:
    """Q1: ANOMALY when the word occurs anywhere in the answer, in any case."""
    return F.when(F.upper(text).contains("ANOMALY"), F.lit("ANOMALY")).otherwise(F.lit("NORMAL"))


def strict_verdict(text: Column) -> Column:
    """Like :func:`verdict`, but "not an anomaly" and "no anomaly" read as NORMAL."""
    plain = F.regexp_replace(F.upper(text), r"\b(NOT|NO|ISN'T|WITHOUT)\s+(AN?\s+|ANY\s+)?ANOMALY", "")
    return F.when(plain.contains("ANOMALY"), F.lit("ANOMALY")).otherwise(F.lit("NORMAL"))


def standard_prompt(entry: Column, dataset_type: str) -> Column:
    template = prompts.STANDARD_TRACES if dataset_type == "eventtraces" else prompts.STANDARD_FLOWS
    return prompts.fill(template, entry=entry)


def standard_prediction(df: DataFrame, text_col: str = "response") -> DataFrame:
    return df.withColumn("prediction", verdict(F.col(text_col))).withColumn("confidence", F.lit(0.5))


def varied_prompts(df: DataFrame, dataset_type: str, num_samples: int = 5, entry_col: str = "line") -> DataFrame:
    """Q2: ``num_samples`` prompts per row; roles and styles repeat after five."""
    traces = dataset_type == "eventtraces"
    roles = prompts.ROLES_TRACES if traces else prompts.ROLES_FLOWS
    styles = prompts.STYLES_TRACES if traces else prompts.STYLES_FLOWS
    template = prompts.VARIED_TRACES if traces else prompts.VARIED_FLOWS
    sampled = df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
    slot = F.col("sample_idx") % len(roles) + 1
    return sampled.withColumn(
        "prompt",
        prompts.fill(
            template, entry=F.col(entry_col),
            role=F.element_at(F.array(*[F.lit(r) for r in roles]), slot),
            style=F.element_at(F.array(*[F.lit(s) for s in styles]), slot),
        ),
    )


def majority_vote(samples: DataFrame, id_col: str = "row_id", pred_col: str = "prediction", order_col: str = "sample_idx") -> DataFrame:
    """Q3: most frequent prediction, ties to the one seen first, with its share and the distribution.

    Two aggregations; the second sees at most one row per (row, verdict).
    """
    counts = samples.groupBy(id_col, F.col(pred_col).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order_col).alias("_first")
    )
    voted = counts.groupBy(id_col).agg(
        F.max_by("_p", F.struct("_n", -F.col("_first"))).alias("prediction"), F.max("_n").alias("votes"),
        F.sum("_n").alias("samples"), F.map_from_entries(F.collect_list(F.struct("_p", "_n"))).alias("prediction_distribution"),
    )
    share = F.col("votes") / F.col("samples")
    return voted.select(
        id_col, "prediction", share.alias("confidence"),
        F.concat(
            F.lit("Majority vote: "), F.col("prediction"), F.lit(" ("), F.col("votes").cast("string"), F.lit("/"),
            F.col("samples").cast("string"), F.lit(" samples)"),
        ).alias("explanation"),
        share.alias("consistency_score"), "prediction_distribution",
    )


def verifier_prompt(entry: Column, prediction: Column, explanation: Column, dataset_type: str) -> Column:
    """Q4, prompt."""
    domain = "distributed systems" if dataset_type == "eventtraces" else "network security"
    return prompts.fill(
        prompts.VERIFIER, domain=F.lit(domain), entry=entry, prediction=prediction,
        explanation=F.coalesce(explanation, F.lit("No explanation provided")),
    )


def verifier_decision(text: Column) -> Column:
    """Q4, decision: REJECT wins over CONFIRM."""
    upper = F.upper(text)
    return (
        F.when(upper.contains("REJECT"), F.lit("REJECT"))
        .when(upper.contains("CONFIRM"), F.lit("CONFIRM"))
        .otherwise(F.lit("UNCERTAIN"))
    )


def refinement_prompt(entry: Column, prediction: Column, explanation: Column, feedback: Column) -> Column:
    return prompts.fill(
        prompts.REFINEMENT, entry=entry, prediction=prediction,
        explanation=F.coalesce(explanation, F.lit("")), feedback=feedback,
    )


def apply_verifier(verified: DataFrame, refined: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Q5: outcome of the review.

    ``verified``: id, prediction, confidence, explanation, decision.  ``refined``: id and
    refined_text, for the rejected rows only.
    """
    answers = refined.select(F.col(id_col).alias("_id"), F.col("refined_text"))
    joined = verified.join(answers, F.col(id_col) == F.col("_id"), "left").drop("_id")
    rejected = F.col("decision") == "REJECT"
    boosted = F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)) + F.lit(0.2))
    return joined.select(
        *[c for c in verified.columns],
        F.when(rejected, verdict(F.col("refined_text"))).otherwise(F.col("prediction")).alias("verified_prediction"),
        F.when(rejected, F.lit(0.7)).when(F.col("decision") == "CONFIRM", boosted)
        .otherwise(F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).alias("verified_confidence"),
        F.when(rejected, F.col("refined_text"))
        .otherwise(F.concat(F.lit("Verified: "), F.coalesce("explanation", F.lit("")))).alias("verified_explanation"),
    )


def final_verdict(df: DataFrame) -> DataFrame:
    """Q6: verifier over vote over standard; each given as a nullable prediction column."""
    return df.withColumn("final_prediction", F.coalesce("verifier_prediction", "vote_prediction", "standard_prediction"))


def labelled_results(verdicts: DataFrame, rows: DataFrame, approach: str, dataset_type: str) -> DataFrame:
    """Q7: verdicts with their true label; a row whose verdict failed stays, with its error."""
    return rows.select("row_id", F.col("sample_order").alias("sample_index"), F.col("label").alias("true_label")).join(
        verdicts, "row_id", "left"
    ).withColumns({
        "approach": F.lit(approach), "dataset_type": F.lit(dataset_type), "evaluation_type": F.lit("reasoning_enhancement"),
    })


def anomaly_status(flag: Column) -> Column:
    """Q8: the detector's opinion in words."""
    return (
        F.when(flag.isNull(), F.lit("UNKNOWN")).when(flag == 1, F.lit("DETECTED_ANOMALY")).otherwise(F.lit("DETECTED_NORMAL"))
    )


def unlabelled_results(verdicts: DataFrame, detected: DataFrame, approach: str, dataset_type: str) -> DataFrame:
    """Q8: verdicts next to the detector flag of the same row, where there is one."""
    flags = detected.select(F.col("row_id").alias("_id"), F.col("is_anomaly"))
    return (
        verdicts.join(flags, F.col("row_id") == F.col("_id"), "left").drop("_id")
        .withColumn("anomaly_status", anomaly_status(F.col("is_anomaly")))
        .withColumn("detected_as_anomaly", F.col("is_anomaly") == 1).drop("is_anomaly")
        .withColumns({
            "sample_index": F.col("row_id"), "true_label": F.lit(None).cast("int"), "approach": F.lit(approach),
            "dataset_type": F.lit(dataset_type), "evaluation_type": F.lit("reasoning_enhancement_unlabeled"),
        })
    )
