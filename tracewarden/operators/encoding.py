"""Category codes, scaling and template look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators.ranking import order_rank
from tracewarden.session import materialize

IDENTIFIER_COLUMNS = ["id", "srcip", "sport", "dstip", "dsport", "stime", "ltime", "sttl", "dttl", "ct_state_ttl"]
TEXT_VIEW_DROPS = ["id", "sttl", "dttl", "ct_state_ttl"]
TEXT_VIEW_CATEGORIES = ["proto", "service", "state"]
LABEL_COLUMNS = ["label", "attack_cat"]
MAP_LIMIT = 256


def drop_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop whichever of ``columns`` exist."""
    return df.drop(*[c for c in columns if c in df.columns])


def label_from_category(col: Column) -> Column:
    """1 unless the category is 'Normal'; a missing category counts as an anomaly."""
    return (~col.eqNullSafe(F.lit("Normal"))).cast("int")


def category_codes(df: DataFrame, columns: list[str], null_word: str) -> DataFrame:
    """Rank of every distinct string per column, from 0: ``(column_name, value, code)``.

    One pass collects the distinct strings of all columns; they are ranked in ranges cut by the strings themselves, so a prefix that
    all of them share fills no single task.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(null_word)).alias("value")) for c in columns]
    found = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.column_name", "cell.value").distinct()
    ranked = order_rank(found, ["value"], ["column_name"])
    return ranked.select("column_name", "value", F.col("rank").cast("int").alias("code"))


def ordinal_encode(df: DataFrame, columns: list[str], null_word: str, codes: DataFrame | None = None) -> DataFrame:
    """Replace each string column by its code; ``codes`` fitted elsewhere may be passed in.

    The code table is written once and read per column; its size on disk then tells Spark whether
    to broadcast it.
    """
    if not columns:
        return df
    table = codes if codes is not None else materialize(category_codes(df, columns, null_word))
    out = df
    for c in columns:
        one = table.where(F.col("column_name") == c).select(
            F.col("value").alias("_value"), F.col("code").alias(f"_code_{c}")
        )
        key = F.coalesce(F.col(c).cast("string"), F.lit(null_word))
        out = out.join(one, key == F.col("_value"), "left").drop("_value")
    return out.select(*[F.col(f"_code_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def min_max_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row holding the range of every column."""
    return df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"_lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"_hi_{c}") for c in columns],
    )


def min_max_scale(df: DataFrame, columns: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """Each column to [0, 1]; a constant column becomes 0."""
    if not columns:
        return df
    row = (bounds if bounds is not None else min_max_bounds(df, columns)).first()
    scaled = []
    for c in df.columns:
        if c in columns:
            lo, hi = row[f"_lo_{c}"], row[f"_hi_{c}"]
            value = F.lit(0.0) if lo == hi or lo is None else (F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo)
            scaled.append(F.when(F.col(c).isNotNull(), value).alias(c))
        else:
            scaled.append(F.col(c))
    return df.select(*scaled)


def string_columns(df: DataFrame, skip: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def enrich_tokens(
    df: DataFrame, line_col: str, templates: DataFrame, map_limit: int = MAP_LIMIT,
) -> DataFrame:
    """Replace every known event id in a line by its template, other tokens stay.

    Up to ``map_limit`` templates travel as one map and lines never leave their partition.  A larger
    table is joined on the exploded tokens and each line is rebuilt by token position.  Both give the same rows: a null
    line stays null, rows that share an id stay apart, of several templates for an id the largest counts.
    """
    tokens = F.filter(F.split(F.col(line_col), r"\s+"), lambda t: t != "")
    few = templates.groupBy("EventId").agg(F.max("EventTemplate").alias("EventTemplate")).limit(map_limit + 1).collect()
    if len(few) <= map_limit:
        if not few:
            return df.withColumn(line_col, F.array_join(tokens, " "))
        lookup = F.create_map(*[F.lit(x) for pair in few for x in pair])
        return df.withColumn(line_col, F.array_join(F.transform(tokens, lambda t: F.coalesce(lookup[t], t)), " "))
    # a number for each row, since rows may share an id; it is fixed before the rows are dealt out
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    # the other columns travel once for each line, with its first token, and the line itself does not
    others = [c for c in df.columns if c != line_col]
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    exploded = numbered.select("_row", *others, F.col(line_col).isNotNull().alias("_known"), F.posexplode_outer(tokens).alias("_pos", "_token")).select(
        "_row", "_known", "_pos", "_token", F.when(first, F.struct("_row", *others)).alias("_others"))
    known = templates.groupBy(F.col("EventId").alias("_token")).agg(F.max("EventTemplate").alias("_template"))
    words = F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_template", "_token").alias("_word"))))
    # the tokens of one line make one group, so the list is as long as the line
    return (
        exploded.join(known, "_token", "left")
        .groupBy("_row")
        .agg(words.alias("_words"), F.any_value("_known").alias("_known"), F.any_value("_others", F.lit(True)).alias("_others"))
        .select(*[
            F.when(F.col("_known"), F.array_join(F.transform("_words", lambda s: s["_word"]), " ")).alias(c) if c == line_col else F.col(f"_others.`{c}`").alias(c)
            for c in df.columns])
    )
