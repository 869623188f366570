"""Readers and the preparation each record kind needs.

A source is a CSV path (header line, every field read as text or by an explicit schema) or a
DataFrame that already has a ``row_id``.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions import text
from tracewarden.operators import encoding, sampling
from tracewarden.session import materialize

logger = logging.getLogger(__name__)

EVENT_TRACE_SCHEMA = T.StructType([T.StructField("Features", T.StringType()), T.StructField("Label", T.StringType())])


def with_source_position(df: DataFrame) -> DataFrame:
    """Adds ``row_id``, the 0-based position in the source files, to a file scan.

    Rows of one file block are read in order by one task, so the place inside a block is a
    difference of task-local ids; block offsets come from one small aggregation.  The scan is
    written out first, hence ids can never change when a later plan is recomputed.
    """
    tagged = materialize(
        df.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_local"),
        )
    )
    blocks = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        tagged.join(offsets, ["_file", "_start"])
        .withColumn("row_id", F.col("_offset") + F.col("_local") - F.col("_first"))
        .drop("_file", "_start", "_local", "_first", "_offset")
    )


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?([iI]nf|[iI]nfinity)\s*$"
INTEGER = r"^\s*[+-]?\d{1,18}\s*$"


def found_types(df: DataFrame) -> dict[str, str]:
    """SQL types of text columns that hold only numbers, from one aggregate over all rows.

    Integers throughout make a long, integers with gaps or other numbers a double, as does a column without any value.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        c for i, n in enumerate(names) for c in (
            F.count(F.col(f"`{n}`")).alias(f"known_{i}"), F.count_if(F.col(f"`{n}`").rlike(INTEGER)).alias(f"long_{i}"),
            F.count_if(F.col(f"`{n}`").rlike(NUMBER)).alias(f"double_{i}"))
    ]).first()
    out = {}
    for i, name in enumerate(names):
        if counts["rows"] and counts[f"long_{i}"] == counts["rows"]:
            out[name] = "bigint"
        elif counts["rows"] and counts[f"double_{i}"] == counts[f"known_{i}"]:
            out[name] = "double"
    return out


def read_csv(
    spark: SparkSession, path: str, id_col: str | None = None, schema: T.StructType | None = None,
    numeric_columns: dict[str, str] | None = None, infer_types: bool = False, multi_line: bool = False,
) -> DataFrame:
    """S9 + B16: fields as text, missing-value words to null, ``row_id`` from ``id_col`` or position.

    ``numeric_columns`` (name to SQL type) are converted after the null words are removed; ``infer_types`` finds them from
    the values.  A record whose number of fields is wrong raises an error.  Quoted line breaks need ``multi_line``, which reads each
    file in one task; without it they raise the same error.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("mode", "FAILFAST")
    raw = reader.schema(schema).csv(path) if schema else reader.csv(path)
    positioned = raw.withColumn("row_id", F.col(id_col) if infer_types else F.col(id_col).cast("long")) if id_col else with_source_position(raw)
    cleaned = positioned.select(*[
        (text.null_if_missing(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name)
        for f in positioned.schema.fields])
    wanted = {**(found_types(cleaned) if infer_types else {}), **(numeric_columns or {})}
    return cleaned.select(*[
        (F.trim(F.col(f"`{c}`")).try_cast(wanted[c]) if c in wanted else F.col(f"`{c}`")).alias(c) for c in cleaned.columns])


def _frame(spark: SparkSession, source: str | DataFrame, id_col: str | None = None, infer_types: bool = False) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    return read_csv(spark, source, id_col, infer_types=infer_types)


def seeded_or_all(spark: SparkSession, source: str | DataFrame, nlines: int | None) -> DataFrame:
    """The rows of a source, sampled when ``nlines`` asks for fewer."""
    return sampling.seeded_sample(_frame(spark, source), nlines)


def load_log_templates(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """``(EventId, EventTemplate)`` cleaned; an unreadable file gives an empty table and a warning."""
    empty = spark.createDataFrame([], "EventId string, EventTemplate string")
    try:
        raw = _frame(spark, source)
        missing = {"EventId", "EventTemplate"} - set(raw.columns)
        if missing:
            raise ValueError(f"missing columns {sorted(missing)}")
    except (AnalysisException, ValueError) as error:
        logger.warning("templates not read: %s", error)
        return empty
    cleaned = raw.where(F.col("EventId").isNotNull() & F.col("EventTemplate").isNotNull()).select(
        F.col("EventId").cast("string").alias("EventId"), text.clean_template(F.col("EventTemplate")).alias("EventTemplate"),
        "row_id",
    )
    # a later line for the same id wins
    return cleaned.groupBy("EventId").agg(F.max_by("EventTemplate", "row_id").alias("EventTemplate"))


def load_event_traces(
    spark: SparkSession, source: str | DataFrame, nlines: int | None = None, preprocessing: dict | None = None,
) -> DataFrame:
    """``(row_id, line, label)`` from Features and Label."""
    options = preprocessing or {}
    rows = sampling.seeded_sample(_frame(spark, source), nlines)
    skip_missing = options.get("skip_missing_labels", True)
    if skip_missing:
        rows = rows.where(F.col("Label").isNotNull() & F.col("Features").isNotNull())
    parse = text.event_line if options.get("parse_features", True) else text.raw_line
    # a trace without events parses to the empty line and is dropped
    line = F.when(F.col("Features").isNull(), F.lit("missing")).otherwise(parse(F.col("Features")))
    # the generator computes the line once; a filter on it would be pushed down and parse twice
    kept = F.explode(F.filter(F.array(line), lambda found: found != ""))
    out = rows.select("row_id", kept.alias("line"), text.trace_label(F.col("Label")).alias("label"))
    if options.get("enable_semantic_enrichment") and options.get("templates") is not None:
        return encoding.enrich_tokens(out, "line", options["templates"])
    return out


def flow_label(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds ``_label`` from ``label``, else from ``attack_cat``."""
    if "label" in df.columns:
        return df.withColumn("_label", F.col("label").cast("int")), encoding.LABEL_COLUMNS
    if "attack_cat" in df.columns:
        return df.withColumn("_label", encoding.label_from_category(F.col("attack_cat"))), encoding.LABEL_COLUMNS
    raise ValueError("no label column: expected 'label' or 'attack_cat'")


def load_unsw_nb15(
    spark: SparkSession, source: str | DataFrame, nlines: int | None = None, preprocessing: dict | None = None,
    codes: DataFrame | None = None,
) -> DataFrame:
    """S3: flows as text, ``(row_id, line, label)``."""
    options = preprocessing or {}
    rows = sampling.seeded_sample(_frame(spark, source, infer_types=True), nlines)
    if options.get("remove_duplicates", False):
        rows = sampling.drop_duplicate_rows(rows)
    rows, label_cols = flow_label(rows)
    rows = encoding.drop_present(rows, encoding.TEXT_VIEW_DROPS + label_cols)
    features = [c for c in rows.columns if c not in ("row_id", "_label")]
    if options.get("encode_categorical", True):
        categories = [c for c in encoding.TEXT_VIEW_CATEGORIES if c in features]
        rows = encoding.ordinal_encode(rows, categories, "unknown", codes)
    if options.get("handle_missing", True):
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        rows = rows.select(
            "row_id", "_label", *[text.to_number(F.col(c), kinds[c]).alias(c) for c in features]
        )
    numeric_only = not encoding.string_columns(rows, ["row_id", "_label"])
    return rows.select("row_id", text.render_row(rows, features, numeric_only).alias("line"), F.col("_label").alias("label"))


def _scaled_features(rows: DataFrame, features: list[str], keep: list[str], codes, bounds) -> DataFrame:
    encoded = encoding.ordinal_encode(rows, encoding.string_columns(rows, keep), "nan", codes)
    scaled = encoding.min_max_scale(encoded, features, bounds)
    return scaled.select(*keep, F.array(*features).alias("features"))


def load_unsw_nb15_cleaned(
    spark: SparkSession, source: str | DataFrame, label_col: str = "label", drop_cols: list[str] | None = None,
    nlines: int | None = None, multi_class: bool = False, leak_compat: bool = False, keep: list[str] | None = None,
    codes: DataFrame | None = None, bounds: DataFrame | None = None,
) -> DataFrame:
    """``(row_id, features, label)`` scaled to [0, 1].

    Both label columns leave the features; ``leak_compat`` keeps the other one in.  ``codes`` and
    ``bounds`` fitted on other rows may be passed in; ``keep`` carries further columns through.
    """
    rows = sampling.seeded_sample(_frame(spark, source, infer_types=True), nlines)
    if label_col not in rows.columns:
        raise ValueError(f"label column '{label_col}' not found")
    kept = ["row_id", *(keep or [])]
    if multi_class and label_col == "attack_cat":
        rows = encoding.ordinal_encode(
            rows.withColumn("_label", F.col(label_col)), ["_label"], "nan",
        )
    else:
        rows = rows.withColumn("_label", F.col(label_col).cast("int"))
    drops = list(drop_cols if drop_cols is not None else encoding.IDENTIFIER_COLUMNS)
    drops += [label_col] if leak_compat else encoding.LABEL_COLUMNS
    rows = encoding.drop_present(rows, [c for c in drops if c not in kept])
    features = [c for c in rows.columns if c not in kept + ["_label"]]
    return _scaled_features(rows, features, [*kept, "_label"], codes, bounds).withColumnRenamed("_label", "label")


def load_hdfs_unlabeled(spark: SparkSession, source: str | DataFrame, nlines: int | None = None) -> DataFrame:
    """The first ``nlines`` log lines as text with their event columns."""
    rows = _frame(spark, source)
    if nlines and isinstance(source, str):  # ids are the places in the file
        rows = rows.where(F.col("row_id") < nlines)
    elif nlines:
        rows = rows.orderBy("row_id").limit(nlines)
    parts = [F.col(c).cast("string") for c in text.LOG_LINE_COLUMNS if c in rows.columns]
    extra = [c for c in ("LineId", "EventId", "EventTemplate") if c in rows.columns]
    return rows.select("row_id", F.concat_ws(" ", *parts).alias("line"), *extra)


def load_unsw_nb15_unlabeled(spark: SparkSession, source: str | DataFrame, nlines: int | None = None) -> DataFrame:
    """``(row_id, line, features)``; the text is rendered before the categories are encoded."""
    rows = sampling.seeded_sample(_frame(spark, source, infer_types=True), nlines)
    rows = encoding.drop_present(rows, encoding.IDENTIFIER_COLUMNS + encoding.LABEL_COLUMNS)
    features = [c for c in rows.columns if c != "row_id"]
    numeric_only = not encoding.string_columns(rows, ["row_id"])
    rows = rows.withColumn("line", text.render_row(rows, features, numeric_only))
    return _scaled_features(rows, features, ["row_id", "line"], None, None)


def load_dataset(
    spark: SparkSession, source: str | DataFrame, dataset_type: str = "eventtraces", nlines: int | None = None,
    preprocessing: dict | None = None,
) -> DataFrame:
    """S1."""
    if dataset_type == "eventtraces":
        return load_event_traces(spark, source, nlines, preprocessing)
    if dataset_type == "unsw-nb15":
        return load_unsw_nb15(spark, source, nlines, preprocessing)
    raise ValueError(f"unknown dataset type: {dataset_type}")


def load_dataset_unlabeled(
    spark: SparkSession, source: str | DataFrame, dataset_type: str = "hdfs", nlines: int | None = None,
) -> DataFrame:
    """S5."""
    if dataset_type == "hdfs":
        return load_hdfs_unlabeled(spark, source, nlines)
    if dataset_type == "unsw-nb15":
        return load_unsw_nb15_unlabeled(spark, source, nlines)
    raise ValueError(f"unknown unlabeled dataset type: {dataset_type}")
