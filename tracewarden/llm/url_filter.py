"""URL verdicts from pattern rules that are indexed by their rarest literal token.

Only DataFrame functions.  A rule names a host and a path prefix, ``example.net/en/``; it fits that host and all its
subdomains where the path starts with the prefix, and the longest fitting rule decides.  Host labels and path segments
are tokens.  Each rule is kept under the token of its own that is rarest among the tokens of all URLs; a URL's tokens
fetch the rules kept under them, and only those rules' regular expressions run.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = "[/.]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(rule, verdict, pattern, tokens)`` of ``(verdict, host-and-path)`` pairs.

    Tokens that a separator or the host's beginning bounds on both sides are literal; a rule without any goes under the
    empty token, which every URL carries.
    """
    entries = []
    for verdict, text in rules:
        host, slash, path = text.partition("/")
        whole = re.split(SEPARATORS, f"{host}{slash}{path}" if slash else f"{host}/")[:-1]
        tokens = [t for t in whole if t] or [""]
        # the java regex quoting of a literal; a rule without a path fits every path of its host
        end = f"\\Q{slash}{path}\\E" if slash else "(?:/|$)"
        entries.append(F.struct(
            F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(f"^(?:[^/]*\\.)?\\Q{host}\\E{end}").alias("pattern"),
            F.array(*[F.lit(t) for t in tokens]).alias("tokens")))
    return spark.range(1).select(F.inline(F.array(*entries)))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of these names are replaced.

    ``rules`` as from ``rule_table``.  URLs no rule fits, also null ones, get the verdict ``otherwise`` and a null rule.
    Each distinct URL is judged once, so repeated rows and a URL with most of the rows cost nothing more.  Of fitting
    rules of equal length the alphabetically last decides.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    words = F.split(F.concat("host", "path"), SEPARATORS)
    tokens = urls.select("url", F.concat("host", "path").alias("address"), F.explode(F.array_distinct(F.concat(words, F.array(F.lit(""))))).alias("token"))
    of_rules = rules.select("rule", F.explode(F.array_distinct("tokens")).alias("token"))
    counts = tokens.join(of_rules.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = (
        of_rules.join(counts, "token", "left").groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).getField("token").alias("token"))
    )
    index = rules.select("rule", "verdict", "pattern").join(rarest, "rule")
    fitting = tokens.join(index, "token").where(F.expr("address rlike pattern"))
    best = fitting.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    decided = best.select(F.col("url").alias("_url"), F.col("best.rule").alias("_rule"), F.col("best.verdict").alias("_verdict"))
    joined = pages.join(decided, pages["url"] == decided["_url"], "left")
    own = [pages[c] for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]
    host, path = split_url(pages["url"])
    return joined.select(
        *own, host.alias("host"), path.alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(otherwise)).alias("verdict"))
