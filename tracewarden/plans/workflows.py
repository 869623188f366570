"""End-to-end evaluations: labelled single file, labelled flow pair, unlabelled, and many models."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators import clustering, detectors, inference, metrics, reasoning, retrieval, sampling, supervised, telemetry, vectors
from tracewarden.operators.silhouette import centroid_silhouette, silhouette
from tracewarden.session import brief, materialize, side_by_side, spread
from tracewarden.sources import loaders, sinks

logger = logging.getLogger(__name__)

RETRIEVED = 3
EXAMPLES = 2  # test lines explained with retrieved context


@dataclass
class Settings:
    """What varies between runs."""

    embedder: object = "hashing"
    generator: object = "rules"
    samples: int = 3  # verdicts per row; 0 turns the vote off
    verifier: bool = True
    sampling: dict = field(default_factory=dict)
    results_dir: str | None = None
    classifiers: dict | None = None
    reasoning: bool = True
    silhouette: str | None = "exact"  # or "centroid", which is linear in the rows, or None
    usage: DataFrame | None = None  # resource samples taken meanwhile: timestamp, cpu_percent, memory_used_gb, total_estimated_power


@dataclass
class Outcome:
    """Tables of one run; a run that failed has only ``results`` with an error row."""

    results: DataFrame
    embeddings: DataFrame | None = None
    projection: DataFrame | None = None
    retrieval: DataFrame | None = None
    reasoning: DataFrame | None = None
    votes: DataFrame | None = None
    clusters: DataFrame | None = None


class OperationLog:
    """When each operation of a run began and ended."""

    def __init__(self):
        self.spans: list[tuple[str, float, float]] = []

    @contextmanager
    def timed(self, operation: str):
        started = time.time()
        try:
            yield
        finally:
            self.spans.append((operation, started, time.time()))

    def seconds(self, operation: str) -> float:
        return sum(end - start for name, start, end in self.spans if name == operation)

    def attach(self, results: DataFrame, operation: str, usage: DataFrame | None) -> DataFrame:
        """Mean CPU, memory and power of the samples taken during an operation, 0 without any, and its seconds."""
        spans = [(start, end) for name, start, end in self.spans if name == operation]
        inside = F.lit(False)
        for start, end in spans:
            inside = inside | F.col("timestamp").between(start, end)
        keyed = results.withColumn("_operation", F.lit(operation))
        if usage is None:
            zero = {name: F.lit(0.0) for name in ("cpu_usage_mean", "memory_usage_gb_mean", "power_consumption_mean_w")}
            return keyed.withColumns({**zero, "duration_seconds": F.lit(self.seconds(operation))}).drop("_operation")
        measured = telemetry.operation_summary(usage.where(inside).withColumn("_operation", F.lit(operation)), ["_operation"])
        joined = telemetry.attach_usage(keyed, measured, "_operation")
        return joined.withColumn("duration_seconds", F.lit(self.seconds(operation))).drop("_operation")


def reason(rows: DataFrame, dataset_type: str, settings: Settings) -> DataFrame:
    """Q1–Q6 on ``rows(row_id, line)``: every verdict and the final one."""
    ask = lambda df, out: inference.generate(df, "prompt", settings.generator, out=out)
    entry = F.col("line")
    base = materialize(ask(rows.select("row_id", "line", reasoning.standard_prompt(entry, dataset_type).alias("prompt")), "standard_text"))
    table = base.select("row_id", "line", "standard_text", reasoning.verdict(F.col("standard_text")).alias("standard_prediction"))
    if settings.samples:
        asked = ask(reasoning.varied_prompts(rows.select("row_id", "line"), dataset_type, settings.samples), "response")
        votes = reasoning.majority_vote(asked.withColumn("prediction", reasoning.verdict(F.col("response"))))
        table = table.join(votes.select(
            "row_id", F.col("prediction").alias("vote_prediction"), F.col("confidence").alias("vote_confidence"),
            F.col("explanation").alias("vote_explanation"), "prediction_distribution",
        ), "row_id")
    else:
        none = F.lit(None).cast("string")
        table = table.withColumns({"vote_prediction": none, "vote_confidence": none.cast("double"), "vote_explanation": none})
    table = table.withColumns({
        "prediction": F.coalesce("vote_prediction", "standard_prediction"),
        "confidence": F.coalesce("vote_confidence", F.lit(0.5)),
        "explanation": F.coalesce("vote_explanation", "standard_text"),
    })
    if settings.verifier:
        review = table.withColumn("prompt", reasoning.verifier_prompt(entry, F.col("prediction"), F.col("explanation"), dataset_type))
        reviewed = materialize(ask(review, "verifier_text").drop("prompt").withColumn("decision", reasoning.verifier_decision(F.col("verifier_text"))))
        again = reviewed.where(F.col("decision") == "REJECT").select(
            "row_id", reasoning.refinement_prompt(entry, F.col("prediction"), F.col("explanation"), F.col("verifier_text")).alias("prompt")
        )
        refined = materialize(ask(again, "refined_text"))
        table = reasoning.apply_verifier(reviewed, refined).withColumn("verifier_prediction", F.col("verified_prediction"))
    else:
        table = table.withColumn("verifier_prediction", F.lit(None).cast("string"))
    return reasoning.final_verdict(table)


def explain_with_context(train: DataFrame, test: DataFrame, dataset_type: str, settings: Settings) -> DataFrame:
    """R1–R6 on the first test lines: similar training lines, prompt, answer, spans."""
    queries = test.orderBy("row_id").limit(EXAMPLES)
    hits = retrieval.search(queries, train, RETRIEVED)
    prompts = retrieval.retrieval_rows(queries, retrieval.context_text(hits, train), dataset_type)
    log = OperationLog()
    with log.timed("generate"):
        answered = materialize(inference.generate(prompts, "prompt", settings.generator))
    each = log.seconds("generate") / max(1, answered.count())
    return retrieval.retrieval_results(answered, top_k=RETRIEVED).withColumn("generation_time", F.lit(each))


def _error_row(spark: SparkSession, approach: str, error: Exception, dataset_type: str, nlines: int | None) -> DataFrame:
    return spark.createDataFrame(
        [(approach, brief(error), dataset_type, nlines)],
        "approach string, error string, dataset_type string, nlines long",
    )


def _save(outcome: Outcome, approach: str, settings: Settings) -> None:
    if not settings.results_dir:
        return
    sinks.save_results(outcome.results, "results", approach, settings.results_dir)
    for kind in ("retrieval", "reasoning"):
        table = getattr(outcome, kind)
        if table is not None:
            sinks.save_results(table, kind, approach, settings.results_dir)
    if outcome.embeddings is not None:
        sinks.save_embeddings(outcome.embeddings, approach, settings.results_dir)


def _labelled(parts: DataFrame, approach: str, dataset_type: str, nlines: int | None, settings: Settings, seconds: float) -> Outcome:
    """Everything after embedding, for a table with line, label, split and embedding."""
    usable = parts.where(F.col("embedding").isNotNull())
    n = parts.count()
    reduced, model = vectors.fit_train_apply_all(usable)
    projection, _ = vectors.projection_table(reduced)
    results = supervised.evaluate_embeddings_cv(reduced, approach, dataset_type, classifiers=settings.classifiers)
    results = results.withColumns({
        "nlines": F.lit(nlines if nlines else n).cast("long"), "embedding_time": F.lit(seconds),
        "sec_per_1k_logs": metrics.seconds_per_thousand(F.lit(seconds), F.lit(nlines if nlines else n)), **backend_columns(parts, settings),
    })
    train, test = usable.where(F.col("split") == "train"), usable.where(F.col("split") == "test")
    context = explain_with_context(train, test, dataset_type, settings)
    verdicts = None
    if settings.reasoning:
        rows = materialize(sampling.pick_reasoning_rows(test.select("row_id", "line", "label"), **settings.sampling))
        verdicts = reasoning.labelled_results(reason(rows, dataset_type, settings), rows, approach, dataset_type)
    return Outcome(results, parts.select("row_id", "split", "label", "embedding"), projection, context, verdicts)


def run_standard(
    spark: SparkSession, source, approach: str, dataset_type: str = "eventtraces", nlines: int | None = None,
    preprocessing: dict | None = None, settings: Settings | None = None,
) -> Outcome:
    """Load, split 80/20, embed, reduce, cross-validate, explain, reason."""
    options = settings or Settings()
    try:
        lines = loaders.load_dataset(spark, source, dataset_type, nlines, preprocessing)
        split = materialize(sampling.stratified_split(lines))
        started = time.time()
        parts = materialize(inference.embed(spread(split), "line", options.embedder))
        outcome = _labelled(parts, approach, dataset_type, nlines, options, time.time() - started)
    except Exception as error:  # noqa: BLE001 - the run ends in an error row
        logger.error("%s failed: %s", approach, brief(error))
        outcome = Outcome(_error_row(spark, f"{approach}_error", error, dataset_type, nlines))
    _save(outcome, approach, options)
    return outcome


def run_flow_pair(
    spark: SparkSession, train_source, test_source, approach: str, nlines: int | None = None, settings: Settings | None = None,
) -> Outcome:
    """The given train and test flows; extra-trees baseline, then the steps of W1 without a new split."""
    options = settings or Settings()
    kind = "unsw-nb15"
    try:
        log = OperationLog()
        with log.timed("traditional_ml"):
            baseline = supervised.evaluate_flows(spark, train_source, test_source, nlines)
        train = loaders.load_dataset(spark, train_source, kind, nlines)
        test = loaders.load_dataset(spark, test_source, kind, nlines)
        both = sampling.union_parts(train, test)
        lines = materialize(both.withColumn("row_id", F.col("row_id") * 2 + (F.col("split") == "test").cast("int")))
        started = time.time()
        parts = materialize(inference.embed(spread(lines), "line", options.embedder))
        outcome = _labelled(parts, approach, kind, nlines, options, time.time() - started)
        if baseline is not None:
            rows = baseline.withColumns({
                "approach": F.concat(F.lit(f"{approach}_traditional_"), F.col("classification_type")),
                "classifier": F.concat(F.lit("ExtraTrees_"), F.col("n_estimators").cast("string"), F.lit("_trees")),
                "eval_type": F.lit("research_compliant_traditional"), "methodology": F.lit("5_fold_cv_minmax_no_pca"),
                "dataset_type": F.lit(kind), "nlines": F.lit(nlines).cast("long"),
            })
            rows = log.attach(rows, "traditional_ml", options.usage)
            outcome.results = rows.unionByName(outcome.results, allowMissingColumns=True)
    except Exception as error:  # noqa: BLE001
        logger.error("%s failed: %s", approach, brief(error))
        outcome = Outcome(_error_row(spark, f"{approach}_error", error, kind, nlines))
    _save(outcome, approach, options)
    return outcome


def spark_row(data: DataFrame, name: str) -> DataFrame:
    """One row with a null number, for a measure that was not asked for."""
    return data.sparkSession.createDataFrame([(None,)], f"{name} double")


def backend_columns(parts: DataFrame, settings: Settings) -> dict:
    """``backend`` and ``embedding_metadata`` (backend, rows embedded, dimension) of a run's embedded table."""
    name = settings.embedder if isinstance(settings.embedder, str) else getattr(settings.embedder, "__name__", "custom")
    figures = inference.embedding_metadata(parts).first()
    return {"backend": F.lit(name), "embedding_metadata": F.struct(
        F.lit(name).alias("backend"), F.lit(figures["samples_processed"]).cast("long").alias("samples_processed"),
        F.lit(figures["embedding_dim"]).cast("int").alias("embedding_dim"))}


def unsupervised_result(
    data: DataFrame, approach: str, dataset_type: str, contamination: str | float = "auto", vec_col: str = "embedding",
    silhouette_kind: str | None = "exact",
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """V8, D6, C1–C4, E8–E12 on ``data(row_id, embedding)``: ``(result, combined, votes, clusters)``.

    ``silhouette_kind``: "exact" needs every distance; "centroid" is linear and adds its own column; None leaves both out.
    The column ``silhouette_score`` is 0 where it was not asked for, as where it has no value.
    """
    rate = vectors.resolve_contamination(data, contamination, vec_col)
    votes, combined = detectors.detect_anomalies(data, rate, vec_col=vec_col)
    combined = materialize(combined)
    clusters, _ = clustering.detect_by_clustering(data, vec_col)
    tagged = materialize(data.select("row_id", F.col(vec_col).alias("embedding")).join(clustering.preferred_labels(clusters), "row_id"))
    pieces = [
        metrics.detection_counts(combined), metrics.score_statistics(combined).select("score_mean", "score_std", "score_separation"),
        silhouette(tagged) if silhouette_kind == "exact" else spark_row(data, "silhouette_score"),
        centroid_silhouette(tagged) if silhouette_kind == "centroid" else spark_row(data, "centroid_silhouette_score"),
        metrics.davies_bouldin(tagged), metrics.embedding_statistics(tagged).select("embedding_dim"),
        votes.agg(F.count_distinct("method").alias("num_methods_used")),
    ]
    row = side_by_side(*pieces)
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    result = row.select(
        F.lit(f"{approach}_unsupervised_llm").alias("approach"), F.lit(dataset_type).alias("dataset_type"),
        F.lit(float(rate)).alias("contamination"), F.lit(str(contamination)).alias("contamination_input"),
        F.col("num_anomalies").alias("anomalies_detected"), F.col("num_samples").alias("total_samples"), "anomaly_ratio",
        F.lit("unlabeled").alias("mode"), "embedding_dim", number("score_mean"), number("score_std"), number("score_separation"),
        "num_methods_used", number("silhouette_score"), number("davies_bouldin_score"),
        *([number("centroid_silhouette_score")] if silhouette_kind == "centroid" else []),
    )
    return result, combined, votes, clusters


def run_unlabelled(
    spark: SparkSession, source, approach: str, dataset_type: str = "hdfs", nlines: int | None = None,
    contamination: str | float = "auto", settings: Settings | None = None,
) -> Outcome:
    """Load, embed, detect by vote and by clustering, summarise, reason about what was found."""
    options = settings or Settings()
    try:
        lines = materialize(loaders.load_dataset_unlabeled(spark, source, dataset_type, nlines).select("row_id", "line"))
        started = time.time()
        data = materialize(inference.embed(spread(lines), "line", options.embedder))
        seconds = time.time() - started
        usable = data.where(F.col("embedding").isNotNull())
        result, combined, votes, clusters = unsupervised_result(
            usable, approach, dataset_type, contamination, silhouette_kind=options.silhouette)
        result = result.withColumns({"embedding_time": F.lit(seconds), "nlines": F.lit(nlines).cast("long"), **backend_columns(data, options)})
        verdicts = None
        if options.reasoning:
            flagged = lines.join(combined.select("row_id", "is_anomaly"), "row_id")
            rows = materialize(sampling.pick_reasoning_rows(flagged, flag_col="is_anomaly", **options.sampling))
            kind = "unsw-nb15" if dataset_type == "unsw-nb15" else "eventtraces"
            verdicts = reasoning.unlabelled_results(reason(rows, kind, options), combined, approach, dataset_type)
        outcome = Outcome(result, data.select("row_id", "embedding"), None, None, verdicts, votes, clusters)
        if options.results_dir:
            sinks.save_anomaly_data(combined, usable.select("row_id", "embedding"), approach, options.results_dir)
    except Exception as error:  # noqa: BLE001
        logger.error("%s failed: %s", approach, brief(error))
        outcome = Outcome(_error_row(spark, f"{approach}_unsupervised_error", error, dataset_type, nlines))
    _save(outcome, approach, options)
    return outcome


def run_models(run, spark: SparkSession, models: dict[str, object], results_dir: str, **arguments) -> DataFrame:
    """One run per embedding backend, each into ``results_dir``, then all results as one table.

    A run that fails leaves its error row and the others go on.
    """
    options = arguments.pop("options", {})
    for name, backend in models.items():
        settings = Settings(embedder=backend, results_dir=results_dir, **options)
        run(spark, approach=name, settings=settings, **arguments)
    return sinks.combine_results(spark, results_dir)
