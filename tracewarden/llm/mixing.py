"""Sources mixed to target weights by Poisson replication.

The mean repetition rate of a source is its share of the target over its own size.  Each document's count is the inverse
of the Poisson distribution at a number hashed from the seed and its id, so it does not depend on partitions or retries.
Documents are exploded by their counts and the copies shuffled by sorting on another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import store

PART_RATE = 16.0  # a larger rate is the sum of independent draws of at most this rate, so that exp(-rate) stays exact
PART_TERMS = 80  # P(Poisson(16) > 80) is far below the resolution of the hashed number


def unit_number(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... up to one less than ``PART_TERMS``, added up in this order."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PART_TERMS - 1)), start, step, lambda s: s["c"])


def poisson_count(steps: Column, number: Column) -> Column:
    """The smallest k whose cumulative Poisson probability reaches ``number``, at most ``PART_TERMS``."""
    return F.size(F.filter(steps, lambda c: c < number)).cast("long")


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """``(source, size, rate)``: size in characters of text, rate = total * weight share / size.

    ``weights`` (source, weight); none: every source weighs the same.  ``total``: characters of the mixture, by default
    those of ``docs``.  A source without a weight, or with one that is not above zero, gets rate 0; a source whose texts
    are all empty adds nothing to any weight and has rate 1.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("_source")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        weighed = sizes.join(given, sizes.source.eqNullSafe(given["_source"]), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = store(weighed)  # one row per source; read back, its size tells Spark whether to broadcast it
    sums = weighed.agg(
        F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight")).first()
    target = float(total if total is not None else sums.all_size or 0.0)
    all_weight = float(sums.all_weight or 1.0)
    return weighed.select(
        "source", "size",
        F.when(F.col("size") > 0, F.lit(target) * F.col("weight") / (F.lit(all_weight) * F.col("size")))
        .when(F.col("weight") > 0, 1.0).otherwise(0.0).alias("rate"))


def replicate(docs: DataFrame, rate_table: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with ``rate, copy`` (from 1) and ``shuffle_key``; each row as often as its count, not yet in order.

    A row whose count is 0 is gone.  Rows that repeat a doc_id repeat alike; a null doc_id counts as an id of its own.
    """
    own = [c for c in docs.columns if c not in {"rate", "copy", "shuffle_key"}]
    # what depends on the source alone is worked out once for each source, ahead of the join
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE).cast("int"), F.lit(1))
    given = rate_table.select(F.col("source").alias("_source"), F.col("rate"), parts.alias("_parts")).withColumn(
        "_steps", poisson_steps(F.col("rate") / F.col("_parts")))
    joined = docs.select(*own).join(given, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_parts")), lambda i: poisson_count(F.col("_steps"), unit_number(F.lit(seed), key, i)))
    count = F.aggregate(draws, F.lit(0).cast("long"), lambda a, b: a + b)
    # the count stands in the plan once, so it is worked out once for each row
    copies = joined.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), count), lambda k: k > 0))).drop("_parts", "_steps")
    return copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit("order"), F.lit(str(seed)), key, F.col("copy").cast("string"))))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = 42) -> DataFrame:
    """The mixture in globally shuffled order, with the columns of ``replicate``."""
    return replicate(docs, rates(docs, weights, total), seed).orderBy("shuffle_key", "doc_id", "copy")
