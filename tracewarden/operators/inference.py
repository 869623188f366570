"""Applying a registered batch function to a text column.

A backend is a small class with ``embed(texts)`` and ``generate(prompts, ...)``; a factory builds it
once per task.  Real models plug in here; the two shipped backends are deterministic stand-ins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators.ranking import order_rank
from tracewarden.session import materialize


KEPT_TOKENS, TOKENS_AT_ONCE = 200_000, 100_000
SLICE_BYTES = 1 << 20  # of rows that a backend's input is made of at once


class Backend:
    """What a backend offers; a subclass overrides what it can do."""

    name = "base"

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError(f"{self.name} has no embeddings")

    def generate(self, prompts: list[str], temperature: float = 0.7, max_new_tokens: int = 512) -> list[str]:
        raise NotImplementedError(f"{self.name} has no text generation")


class HashingBackend(Backend):
    """Embedding by token hashing: signed buckets, mean over tokens, unit length.

    bucket = first 7 hex digits of md5(token) modulo size; sign = + when hex digit 8 is below 8.
    """

    name = "hashing"

    def __init__(self, size: int = 64, max_tokens: int | None = None):
        self.size, self.max_tokens = size, max_tokens
        self._codes: dict[str, int] = {}  # of tokens seen so far, at most KEPT_TOKENS

    def _code(self, token: str) -> int:
        """The bucket, plus the size where the sign is negative."""
        digest = hashlib.md5(token.encode()).hexdigest()
        return int(digest[:7], 16) % self.size + (0 if int(digest[7], 16) < 8 else self.size)

    def _count(self, text: str) -> tuple[np.ndarray, int]:
        """Tokens by code, and their number; counts are whole numbers, so their order does not matter."""
        tokens = text.split()[: self.max_tokens]
        known, total = self._codes, np.zeros(2 * self.size, np.int64)
        for at in range(0, len(tokens), TOKENS_AT_ONCE):
            part = tokens[at:at + TOKENS_AT_ONCE]
            codes = list(map(known.get, part))
            if None in codes:
                for i, code in enumerate(codes):
                    if code is None:
                        token = part[i]
                        codes[i] = known[token] = known[token] if token in known else self._code(token)
                if len(known) > KEPT_TOKENS:
                    known.clear()
            total += np.bincount(codes, minlength=2 * self.size)
        return total, len(tokens)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            counts, n = self._count(text)
            if n:
                out[i] = (counts[: self.size] - counts[self.size:]) / n
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


class RuleBackend(Backend):
    """Stand-in for a text model, for tests only: looks for failure words in the quoted record."""

    name = "rules"
    WORDS = ("error", "fail", "exception", "timeout", "corrupt")
    MARKS = ("Event trace: ", "Network data: ", "Original Data: ", "Log to Analyze: ", "Flow to Analyze: ", "Data to Analyze: ")

    def _record(self, prompt: str) -> str:
        for mark in self.MARKS:
            if mark in prompt:
                return prompt.split(mark, 1)[1].split("\n\n", 1)[0]
        return prompt

    def _answer(self, prompt: str) -> str:
        record = self._record(prompt)
        hits = [(record.lower().find(w), w) for w in self.WORDS if w in record.lower()]
        if "Final Verification Decision" in prompt:
            digit = int(hashlib.md5(record.encode()).hexdigest()[0], 16)
            return "REJECT: weak evidence" if digit < 4 else "CONFIRM: sound" if digit < 12 else "UNCERTAIN"
        if "critical_spans" in prompt:
            spans = [{"start": at, "end": at + len(w), "severity": 2, "reason": w} for at, w in hits]
            return json.dumps({"is_anomalous": bool(hits), "critical_spans": spans})
        return f"ANOMALY: {hits[0][1]} seen" if hits else "NORMAL: nothing unusual"

    def generate(self, prompts: list[str], temperature: float = 0.7, max_new_tokens: int = 512) -> list[str]:
        return [self._answer(p) for p in prompts]


class BackendRegistry:
    """I4: name to factory."""

    def __init__(self):
        self._factories: dict[str, Callable[..., Backend]] = {}
        self._about: dict[str, dict] = {}

    def register(self, name: str, factory: type[Backend], description: str = "") -> None:
        if not (isinstance(factory, type) and issubclass(factory, Backend)):
            raise ValueError(f"{factory!r} is not a Backend class")
        self._factories[name] = factory
        self._about[name] = {"name": name, "class": factory.__name__, "description": description}

    def names(self) -> list[str]:
        return sorted(self._factories)

    def info(self, name: str) -> dict:
        self._known(name)
        return dict(self._about[name])

    def maker(self, name: str, **options) -> Callable[[], Backend]:
        self._known(name)
        factory = self._factories[name]
        return lambda: factory(**options)

    def _known(self, name: str) -> None:
        if name not in self._factories:
            raise ValueError(f"unknown backend: {name}. Available: {self.names()}")


registry = BackendRegistry()
registry.register("hashing", HashingBackend, "deterministic token hashing")
registry.register("rules", RuleBackend, "deterministic stand-in for text generation")


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows and about ``SLICE_BYTES``, so that what a task makes of them stays small."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _chunks(n: int, size: int) -> Iterator[slice]:
    for start in range(0, n, size):
        yield slice(start, min(start + size, n))


def embed(
    df: DataFrame, text_col: str = "line", backend: str | Callable[[], Backend] = "hashing", batch_size: int = 200,
    out: str = "embedding", **options,
) -> DataFrame:
    """Adds the vector and an ``error`` column.

    A failing batch is tried again row by row; a row that still fails has a null vector and the
    message.  Rows stay in their partition; nothing is shuffled.
    """
    make = registry.maker(backend, **options) if isinstance(backend, str) else backend
    schema = T.StructType([f for f in df.schema.fields if f.name not in (out, "error")]).add(out, T.ArrayType(T.DoubleType())).add("error", T.StringType())
    kept = [f for f in schema.fieldNames() if f not in (out, "error")]

    def one(worker: Backend, text: str):
        try:
            return worker.embed([text])[0], None
        except Exception as error:  # noqa: BLE001 - becomes data
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = make()
        for part in _slices(batches, batch_size):
            texts = ["" if t is None else t for t in part.column(text_col).to_pylist()]
            try:
                vectors, errors = list(worker.embed(texts)), [None] * len(texts)
            except Exception:  # noqa: BLE001 - narrowed down row by row
                vectors, errors = zip(*(one(worker, t) for t in texts))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(name) for name in kept), pa.array([v if v is None else np.asarray(v, np.float64) for v in vectors], pa.list_(pa.float64())), pa.array(errors, pa.string())],
                [*kept, out, "error"])

    return df.mapInArrow(run, schema)


def generate(
    df: DataFrame, prompt_col: str = "prompt", backend: str | Callable[[], Backend] = "rules", temperature: float = 0.7,
    max_new_tokens: int = 512, batch_size: int = 200, out: str = "response", **options,
) -> DataFrame:
    """Adds the answer to each prompt; an error becomes the text ``[Error: ...]``."""
    make = registry.maker(backend, **options) if isinstance(backend, str) else backend
    schema = T.StructType([f for f in df.schema.fields if f.name != out]).add(out, T.StringType())
    kept = [f for f in schema.fieldNames() if f != out]

    def one(worker: Backend, prompt: str) -> str:
        try:
            return worker.generate([prompt], temperature, max_new_tokens)[0]
        except Exception as error:  # noqa: BLE001 - becomes data
            return f"[Error: {error}]"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = make()
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").tolist()
            answers: list[str] = []
            for part in _chunks(len(prompts), batch_size):
                try:
                    answers += worker.generate(prompts[part], temperature, max_new_tokens)
                except Exception:  # noqa: BLE001
                    answers += [one(worker, p) for p in prompts[part]]
            yield pdf[kept].assign(**{out: pd.Series(answers, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


def embed_with_fallback(df: DataFrame, text_col: str, backends: list[str | Callable[[], Backend]], out: str = "embedding") -> DataFrame:
    """Rows one backend cannot embed go to the next; the last one's errors stay.

    Adds ``backend_attempt`` (1-based) and ``fallback_used``.  Each pass touches only the rows the
    passes before left open.
    """
    todo, done = df, []
    for attempt, backend in enumerate(backends, start=1):
        tried = embed(todo, text_col, backend, out=out).withColumn("backend_attempt", F.lit(attempt)).withColumn(
            "fallback_used", F.lit(attempt > 1)
        )
        if attempt == len(backends):
            done.append(tried)
            break
        tried = materialize(tried)
        done.append(tried.where(F.col("error").isNull()))
        todo = tried.where(F.col("error").isNotNull()).drop(out, "error", "backend_attempt", "fallback_used")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def embedding_metadata(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows embedded, dimension, failures."""
    return df.agg(
        F.count(vec_col).alias("samples_processed"), F.max(F.size(vec_col)).alias("embedding_dim"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


# --------------------------------------------------------------------------- TF-IDF


WORDS = r"[a-z0-9_]{2,}"


def _term_counts(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(id, term, tf)``: words of two or more letters or digits, lower case."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(WORDS), F.lit(0))
    return df.select(id_col, F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


class TfIdfModel:
    """Every fitted term with its number in alphabetical order and its weight; ``transform`` gives sparse unit vectors.

    The terms are a table of their own, so neither their number nor their size is limited by one machine.
    """

    def __init__(self, terms: DataFrame, size: int, text_col: str):
        self.terms, self.size, self.text_col = terms, size, text_col

    def transform(self, df: DataFrame, out: str = "embedding", id_col: str = "row_id") -> DataFrame:
        """Adds ``out``: struct of ``size``, ``indices`` (rising) and ``values``; a text without known words has no entries."""
        weighed = _term_counts(df, self.text_col, id_col).join(self.terms, "term").select(
            id_col, F.struct(F.col("term_id").alias("i"), (F.col("tf") * F.col("idf")).alias("w")).alias("e"))
        # the distinct terms of one text make one group
        entries = weighed.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list("e")).alias("_e"))
        length = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
        # the length is bound once for a text: inside the inner function it would be worked out again for each of its terms
        scaled = F.get(F.transform(F.array(length), lambda whole: F.transform("_e", lambda e: e["w"] / whole)), 0)
        vector = F.struct(
            F.lit(self.size).cast("long").alias("size"), F.coalesce(F.transform("_e", lambda e: e["i"]), F.array().cast("array<long>")).alias("indices"),
            F.coalesce(scaled, F.array().cast("array<double>")).alias("values"))
        return df.join(entries, F.col(id_col) == F.col("_id"), "left").withColumn(out, vector).drop("_id", "_e")


def fit_tfidf(df: DataFrame, text_col: str = "line") -> TfIdfModel:
    """Weight of a term = tf * (ln((n+1)/(df+1)) + 1) over all terms of all texts."""
    n = df.count()
    found = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(WORDS), F.lit(0)))).alias("term"))
    weighed = found.groupBy("term").agg((F.log(F.lit(n + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    terms = order_rank(weighed, ["term"], out="term_id")
    return TfIdfModel(terms, terms.count(), text_col)


def embed_texts(df: DataFrame, text_col: str = "line", embedding_type: str = "backend", vectorizer: TfIdfModel | None = None, **options) -> DataFrame:
    """Embedding by kind: a registered backend, or a fitted TF-IDF vectorizer."""
    if embedding_type == "backend":
        return embed(df, text_col, **options)
    if embedding_type == "tfidf":
        if vectorizer is None:
            raise ValueError("TF-IDF vectorizer not provided")
        return vectorizer.transform(df)
    raise ValueError(f"unknown embedding type: {embedding_type}")


def tfidf_terms(df: DataFrame, text_col: str = "line", id_col: str = "row_id") -> DataFrame:
    """I6 in long form, ``(row_id, term, weight)``, with no vocabulary limit.

    Weight = tf * (ln((n+1)/(df+1)) + 1), scaled to unit length per document.  Terms are counted per
    document before the document frequency is joined, so a frequent term costs one row per document.
    """
    tf = materialize(_term_counts(df, text_col, id_col))
    n = df.count()
    idf = tf.groupBy("term").agg((F.log(F.lit(n + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    # one document's distinct terms make one window, bounded by its length
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / length).alias("weight"))
