"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose share of documents lies in a band: neither words that say nothing nor words nobody
shares.  Every term is in a random half of the subsets of level 1, a quarter of those of level 2 and so on; a document uses the two
levels at which a subset keeps about one of its terms, so that an edit leaves many subsets untouched however long the text is.
A subset's signature hashes the document's sorted distinct terms in it.

A fingerprint reads ``level:signatures|level:signatures``; ``-`` in a signature's place marks a subset without terms.  A
document without lexicon terms falls back to all its terms, one without words to its whole text, marked ``w``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import kept_in_worker, rows_in_chunks

TERM = re.compile(r"\w+")
SUBSETS, DIGITS = 24, 6
LOW_SHARE, HIGH_SHARE = 0.0005, 0.1
EMPTY = "-" * DIGITS


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)`` over all rows of ``docs`` (text)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update(set(TERM.findall((text.as_py() or "").lower())))
                if len(counts) > 200_000:
                    yield out()
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def build_lexicon(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> list[str]:
    """Terms in the band, sorted.

    They are few at any size: a term in at least ``low * n`` documents uses up that many of the n * d pairs of a document
    and one of its d distinct terms on average, so there are at most ``d / low`` such terms.
    """
    n = docs.count()
    band = document_frequencies(docs).where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    return sorted(r.term for r in band.select("term").toLocalIterator())


def term_depths(term: str, subsets: int) -> bytes:
    """One byte per subset: the term is in the subset at all levels up to that depth."""
    bits = np.frombuffer(hashlib.shake_128(term.encode()).digest(4 * subsets), "<u4")
    return np.minimum(32 - np.frexp(bits.astype(np.float64))[1], 31).astype(np.uint8).tobytes()


class Lexicon:
    """Terms with their depths in every subset."""

    def __init__(self, depths: dict[str, bytes], subsets: int = SUBSETS):
        self.subsets, self.depths = subsets, depths

    @classmethod
    def of(cls, terms: list[str], subsets: int = SUBSETS) -> Lexicon:
        return cls({t: term_depths(t, subsets) for t in terms}, subsets)

    def fingerprint(self, text: str) -> str:
        found = set(TERM.findall(text.lower()))
        terms = sorted(t for t in found if t in self.depths)
        mark = ""
        if terms:
            depths = np.frombuffer(b"".join([self.depths[t] for t in terms]), np.uint8)
        else:
            mark, terms = "w", sorted(found) or [text]
            depths = np.frombuffer(b"".join([term_depths(t, self.subsets) for t in terms]), np.uint8)
        depths = np.ascontiguousarray(depths.reshape(len(terms), -1).T)
        level = len(terms).bit_length() - 1
        parts = []
        for each in (level, level + 1):
            inside: list[list[str]] = [[] for _ in range(self.subsets)]
            subset, term = np.nonzero(depths >= each)
            for s, t in zip(subset.tolist(), term.tolist()):  # in the order of the sorted terms
                inside[s].append(terms[t])
            signatures = [
                hashlib.blake2b(" ".join(own).encode(), digest_size=DIGITS // 2).hexdigest() if own else EMPTY for own in inside]
            parts.append(f"{mark}{each}:" + "".join(signatures))
        return "|".join(parts)


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, 0 to 1: the share s of equal signatures on common levels as 2s / (1 + s).

    Subsets in which neither document has a term say nothing; equal fingerprints have likeness 1, ones without a common level 0.
    """
    if a == b:
        return 1.0
    mine, theirs = (dict(p.split(":") for p in f.split("|")) for f in (a, b))
    equal = told = 0
    for level in mine.keys() & theirs.keys():
        x, y = mine[level], theirs[level]
        for i in range(0, len(x), DIGITS):
            left, right = x[i:i + DIGITS], y[i:i + DIGITS]
            if left != EMPTY or right != EMPTY:
                told += 1
                equal += left == right
    share = equal / told if told else 0.0
    return 2 * share / (1 + share)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _kept_lexicon(shared) -> Lexicon:
    depths, name = shared.value
    return kept_in_worker("lexicon", name, lambda: Lexicon(depths))


def compare_with_edit(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row of ``docs``.

    The next document is the one with the next smaller doc_id, after the smallest the one with the largest.  Null texts
    count as empty; rows with a null doc_id come last; rows that repeat a doc_id follow each other in the order of their
    texts.  A single document is its own next one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(lowest)))
    # runs of neighbouring ids, each worked on by one task; beside its own rows a run gets the first row of the next lower run
    runs = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.select(F.percentile_approx("place", [i / runs for i in range(1, runs)], 100 * runs)).first()[0] or []
    bounds = sorted(set(bounds))
    run = F.expr(f"size(filter(array({', '.join(f'{b}L' if b != lowest else 'bigint(-9223372036854775808)' for b in bounds)}), b -> b < place))") if bounds else F.lit(0)
    docs = docs.withColumn("run", run)
    tops = docs.groupBy("run").agg(F.max("place").alias("place")).orderBy("run").collect()
    helpers = [(tops[i - 1].place, tops[i].run) for i in range(len(tops))]  # the lowest run gets the highest document
    if not helpers:
        helpers = [(0, 0)]
    lend = F.broadcast(spark.createDataFrame(helpers, "place long, to_run int"))  # one row per run
    borrowed = docs.join(lend, "place").select("doc_id", "text", "place", F.col("to_run").alias("run"), F.lit(1).alias("borrowed"))
    rows = docs.select("doc_id", "text", "place", "run", F.lit(0).alias("borrowed")).unionByName(borrowed)
    dealt = rows.repartition(runs, "run").sortWithinPartitions("run", "borrowed", F.desc("place"), "text").select("run", "borrowed", "doc_id", "text")
    own_lexicon = Lexicon.of(lexicon)
    shared = spark.sparkContext.broadcast((own_lexicon.depths, uuid.uuid4().hex))  # bounded: see build_lexicon
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _kept_lexicon(shared)
        waiting = None  # (run, doc_id, text, fingerprint) of the row whose next one has not come
        for batch in batches:
            for part in rows_in_chunks([batch]):
                out = []
                for run, lent, doc_id, text in zip(*[part.column(i) for i in range(4)]):
                    run, lent, doc_id, text = run.as_py(), lent.as_py(), doc_id.as_py(), text.as_py()
                    if lent and (waiting is None or waiting[0] != run):
                        continue
                    mark = words.fingerprint(text)
                    if waiting is not None and waiting[0] == run:
                        _, own_id, own, own_mark = waiting
                        other = edited(own, text)
                        other_mark = words.fingerprint(other)
                        out.append((own_id, len(own), hashlib.sha256(other.encode()).hexdigest(), own_mark, other_mark,
                                    likeness(own_mark, other_mark), likeness(own_mark, mark)))
                    waiting = None if lent else (run, doc_id, text, mark)
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return dealt.mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
