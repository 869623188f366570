"""Toxic texts by a convolutional classifier over hashed word embeddings, trained here in numpy.

A word's embedding is the sum of three rows of one hashed table: for the word, its first four and its first five letters.
Filters of several widths slide over the whole text, each keeps its maximum, and a logistic layer reads the
maxima.  Rows nobody trained stay zero, so unknown words say nothing.  The language is guessed from function words in the text; every
language has its own threshold, found on labelled rows that training did not see, and scores are shifted so that all
thresholds come to lie on one value.

Every labelled row that is not held out takes part.  The driver trains on as many as it can hold; where there are more, that model is the
start of rounds over all rows: each shard of rows is trained in a task from the shared model, and what the shards have changed is
averaged, a row of the table over those shards that have changed it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import kept_in_worker, rows_in_chunks, store
from tracewarden.llm.extraction import STOP_WORDS
from tracewarden.session import discard

SAMPLE_DOCS, SAMPLE_BYTES = 8_000, 64 << 20  # labelled rows, and bytes of their texts, that the driver trains on
ROUNDS, LOCAL_EPOCHS, SHARD_BYTES = 3, 1, 24 << 20  # passes over all rows where there are more, each so often in a task of so much text
BLOCKS = 64  # parts of the table that are averaged apart
BROADCAST_IDS = 2_000_000  # labelled ids that travel to the documents; more are joined by a shuffle
ROWS, SIZE, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 12
EPOCHS, LEAST_STEPS, BATCH, RATE, FOLDS = 4, 400, 32, 0.05, 4
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
LANGUAGES = sorted(STOP_WORDS)
FALLBACK = len(LANGUAGES)  # the number of the language that no function word tells
CACHE = 200_000
CHUNK_WORDS = 40_000


class WordRows(dict):
    """Word to 16 bytes: its three table rows and the languages it is a function word of (one bit each)."""

    def __missing__(self, word: str) -> bytes:
        languages = sum(1 << i for i, name in enumerate(LANGUAGES) if word in _STOPS[name]) if len(word) < 10 else 0
        rows = [zlib.crc32(part) % ROWS for part in (word.encode(), b"4" + word[:4].encode(), b"5" + word[:5].encode())]
        self[word] = found = struct.pack("<4i", *rows, languages)
        return found


_STOPS = {name: frozenset(words) for name, words in STOP_WORDS.items()}


def features(text: str | None) -> np.ndarray:
    """One row of four integers for each word of the text."""
    rows = kept_in_worker("word rows", "", WordRows)
    if len(rows) > CACHE:
        rows.clear()
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros((0, 4), np.int32)
    return np.frombuffer(b"".join(map(rows.__getitem__, words)), np.int32).reshape(-1, 4)


def guess_language(languages: np.ndarray) -> int:
    """The language with most function words in a text; ``FALLBACK`` without any."""
    counts = [int(((languages >> i) & 1).sum()) for i in range(len(LANGUAGES))]
    best = int(np.argmax(counts))
    return best if counts[best] else FALLBACK


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    scale: float = 1.0
    squares: dict | None = None  # sums of squared gradients, while it is trained

    def maxima(self, words: np.ndarray, bounds: np.ndarray, places: bool = False):
        """Embeddings of the words, filter maxima of each text and, if asked for, where they are.

        ``bounds``: where each text begins in ``words``, and the end; texts must not be empty.
        """
        embedded = self.table[words[:, 0]]
        embedded += self.table[words[:, 1]]
        embedded += self.table[words[:, 2]]
        ends = np.repeat(bounds[1:], np.diff(bounds))
        tops, where = [], []
        for weights, offset in zip(self.filters, self.offsets):
            width = len(weights)
            sums = embedded @ weights[0]
            for j in range(1, width):  # beyond a text's end the window sees zeros
                shifted = embedded[j:] @ weights[j]
                shifted[np.arange(len(shifted)) + j >= ends[:len(shifted)]] = 0
                sums[:len(shifted)] += shifted
            if places:
                at = np.stack([a + sums[a:b].argmax(0) for a, b in zip(bounds[:-1], bounds[1:])])
                tops.append(np.take_along_axis(sums, at, 0) + offset)
                where.append(at)
            else:
                tops.append(np.maximum.reduceat(sums, bounds[:-1], axis=0) + offset)
        return embedded, np.maximum(np.concatenate(tops, 1), 0), where

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """One number for each text; a text without words has the bias alone."""
        out = np.full(len(texts), self.bias, np.float64)
        some = [i for i, t in enumerate(texts) if len(t)]
        at = 0
        while at < len(some):
            end, size = at, 0
            while end < len(some) and (end == at or size + len(texts[some[end]]) <= CHUNK_WORDS):
                size += len(texts[some[end]])
                end += 1
            group = some[at:end]
            if size <= 2 * CHUNK_WORDS:
                bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in group])])
                _, tops, _ = self.maxima(np.concatenate([texts[i] for i in group])[:, :3], bounds)
                out[group] += tops @ self.weights
            else:  # one very long text: overlapping stretches, so that every window is seen whole
                text, lap = texts[group[0]][:, :3], max(len(f) for f in self.filters) - 1
                best = None
                for a in range(0, len(text), CHUNK_WORDS):
                    part = text[a:a + CHUNK_WORDS + lap]
                    top = self.maxima(part, np.array([0, len(part)]))[1][0]
                    best = top if best is None else np.maximum(best, top)
                out[group[0]] += best @ self.weights
            at = end
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores from 0 to 1, with every language's threshold at ``THRESHOLD``."""
        language = np.array([guess_language(t[:, 3]) for t in texts], int)
        shifted = self.scale * (self.logits(texts) - self.thresholds[language]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.round(1 / (1 + np.exp(-np.clip(shifted, -40, 40))), 6)


def untrained(labels: np.ndarray, rng: np.random.Generator) -> Model:
    model = Model(
        np.zeros((ROWS, SIZE), np.float32),
        [rng.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    model.bias = float(np.log(share / (1 - share)))
    model.squares = {
        "table": np.full((ROWS, 1), 1e-6, np.float32), "weights": np.full_like(model.weights, 1e-6), "bias": 1e-6,
        "filters": [np.full_like(f, 1e-6) for f in model.filters], "offsets": [np.full_like(o, 1e-6) for o in model.offsets]}
    return model


def one_epoch(model: Model, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of AdaGrad over mini-batches of the texts that have words; only the windows at the maxima take part in a step."""
    squares = model.squares
    lengths = np.array([len(t) for t in texts], int)
    order = rng.permutation(np.flatnonzero(lengths > 0))
    at = 0
    while at < len(order):
        size = max(1, int(np.searchsorted(np.cumsum(lengths[order[at:at + BATCH]]), 2 * CHUNK_WORDS)))
        batch = order[at:at + min(BATCH, size)]
        at += len(batch)
        words = np.concatenate([texts[i] for i in batch])[:, :3]
        bounds = np.concatenate([[0], np.cumsum(lengths[batch])])
        embedded, tops, where = model.maxima(words, bounds, places=True)
        logit = tops @ model.weights + model.bias
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[batch]).astype(np.float32)
        pull = (error[:, None] * model.weights) * (tops > 0)
        for name, gradient in (("weights", tops.T @ error), ("bias", float(error.sum()))):
            squares[name] = squares[name] + gradient ** 2
            setattr(model, name, getattr(model, name) - RATE * gradient / np.sqrt(squares[name]))
        touched, changes = [], []
        for k, width in enumerate(WIDTHS):
            own = pull[:, k * FILTERS:(k + 1) * FILTERS]
            gradient = np.zeros_like(model.filters[k])
            for j in range(width):
                place = where[k] + j
                inside = place < bounds[1:, None]
                force = own * inside
                place = np.minimum(place, len(words) - 1)
                gradient[j] = np.einsum("bfd,bf->df", embedded[place], force)
                moved = force[:, :, None] * model.filters[k][j].T[None]
                live = force != 0
                for column in range(3):
                    touched.append(words[place[live], column])
                    changes.append(moved[live])
            squares["filters"][k] += gradient ** 2
            model.filters[k] -= RATE * gradient / np.sqrt(squares["filters"][k])
            offset = own.sum(0)
            squares["offsets"][k] += offset ** 2
            model.offsets[k] -= RATE * offset / np.sqrt(squares["offsets"][k])
        rows, number = np.unique(np.concatenate(touched), return_inverse=True)
        if len(rows):
            gradient = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(gradient, number.ravel(), np.concatenate(changes))
            squares["table"][rows] += (gradient ** 2).mean(1, keepdims=True)
            model.table[rows] -= RATE * gradient / np.sqrt(squares["table"][rows])


def epochs_for(texts: list[np.ndarray]) -> int:
    """More passes over few texts, so that there are some hundred steps."""
    usable = sum(1 for t in texts if len(t))
    return max(EPOCHS, min(40, -(-LEAST_STEPS * BATCH // max(1, usable))))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 42) -> Model:
    """Minimise the logistic loss on rows that one machine holds."""
    rng = np.random.default_rng(seed)
    model = untrained(labels, rng)
    for _ in range(epochs_for(texts)):
        one_epoch(model, texts, labels, rng)
    return model


def _small_parts(model: Model) -> list[np.ndarray]:
    """Everything trained but the table, in one order."""
    squares = model.squares
    return [*model.filters, *model.offsets, model.weights, np.array([model.bias]), *squares["filters"], *squares["offsets"],
            squares["weights"], np.array([squares["bias"]])]


def _with_changes(model: Model, small: np.ndarray, rows: np.ndarray, changes: np.ndarray) -> Model:
    """A model with the numbers ``small`` in place of its small parts, and ``changes`` (entries, square) added to rows of the table."""
    found, at = [], 0
    for part in _small_parts(model):
        found.append(small[at:at + part.size].reshape(part.shape).astype(part.dtype))
        at += part.size
    n = len(WIDTHS)
    table, square = model.table.copy(), model.squares["table"].copy()
    table[rows] += changes[:, :SIZE]
    square[rows] += changes[:, SIZE:]
    squares = {"table": square, "filters": found[2 * n + 2:3 * n + 2], "offsets": found[3 * n + 2:4 * n + 2], "weights": found[-2], "bias": float(found[-1][0])}
    return Model(table, found[:n], found[n:2 * n], found[2 * n], float(found[2 * n + 1][0]), squares=squares)


CHANGES = "block int, rows binary, changes binary, n long"


def _shard_trained(start, number: int, seed: int):
    """A function that trains from the model ``start`` (a broadcast) on a shard's rows and gives what has changed."""
    def work(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        model = _with_changes(start.value, np.concatenate([p.ravel() for p in _small_parts(start.value)]), np.zeros(0, int), np.zeros((0, SIZE + 1), np.float32))
        found = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("toxic").to_pylist()),
                       key=lambda r: (r[0], r[1] or "", r[2]))
        texts, marks = [features(text) for _, text, _ in found], np.array([t > 0 for *_, t in found], np.float32)
        rng = np.random.default_rng([seed, number, shard])
        for _ in range(max(LOCAL_EPOCHS, epochs_for(texts) // ROUNDS)):
            one_epoch(model, texts, marks, rng)
        change = np.column_stack([model.table - start.value.table, model.squares["table"] - start.value.squares["table"]])
        rows = np.flatnonzero(change.any(axis=1)).astype(np.int32)
        out = [(-1, b"", np.concatenate([p.ravel() for p in _small_parts(model)]).astype(np.float64).tobytes(), len(found))]
        for block in np.unique(rows % BLOCKS).tolist():
            own = rows[rows % BLOCKS == block]
            out.append((block, own.tobytes(), change[own].astype(np.float32).tobytes(), len(found)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["block", "rows", "changes", "n"])
    return work


def _averaged(key: tuple, table: pa.Table) -> pa.Table:
    """The mean over shards: of the small parts by their rows, of a table row over the shards that have changed it."""
    table = table.sort_by([("n", "ascending"), ("changes", "ascending")])  # in one order, so that sums are the same in every run
    n = table.column("n").to_numpy()
    if key[0].as_py() < 0:
        mean = sum(np.frombuffer(c, np.float64) * k for c, k in zip(table.column("changes").to_pylist(), n)) / n.sum()
        rows, changes = np.zeros(0, np.int32), mean
    else:
        total, times = np.zeros((-(-ROWS // BLOCKS), SIZE + 1)), np.zeros(-(-ROWS // BLOCKS))
        for r, c in zip(table.column("rows"), table.column("changes")):
            own = np.frombuffer(r.as_buffer(), np.int32) // BLOCKS
            total[own] += np.frombuffer(c.as_buffer(), np.float32).reshape(-1, SIZE + 1)
            times[own] += 1
        own = np.flatnonzero(times)
        rows, changes = (own * BLOCKS + key[0].as_py()).astype(np.int32), (total[own] / times[own, None]).astype(np.float32)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([changes.tobytes()], pa.binary()),
                     pa.array([int(n.sum())], pa.int64())], ["block", "rows", "changes", "n"])


def go_on(model: Model, rows: DataFrame, shards: int, seed: int = 42) -> Model:
    """``model`` trained in rounds over all of ``rows`` (doc_id, text, toxic) in so many shards."""
    dealt = rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))
    for number in range(ROUNDS):
        start = rows.sparkSession.sparkContext.broadcast(model)  # a fixed size, like what the averages bring back
        changed = dealt.groupBy("shard").applyInArrow(_shard_trained(start, number, seed), CHANGES)
        found = changed.groupBy("block").applyInArrow(_averaged, CHANGES).collect()
        small = next(np.frombuffer(r.changes, np.float64) for r in found if r.block < 0)
        some = [r for r in found if r.block >= 0]
        where = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r.rows, np.int32) for r in some)])
        changes = np.concatenate([np.zeros((0, SIZE + 1), np.float32), *(np.frombuffer(r.changes, np.float32).reshape(-1, SIZE + 1) for r in some)])
        model = _with_changes(model, small, where, changes)
        start.destroy()
    return model


def best_threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float | None:
    """The cut with the best F1, in the middle of its gap; of equally good ones the middle one.  None without both labels.

    ``counts``: how many rows each entry stands for.
    """
    if not len(labels) or labels.min() == labels.max():
        return None
    order = np.argsort(-logits, kind="stable")
    ranked, hits, seen = logits[order], np.cumsum((labels * counts)[order]), np.cumsum(counts[order])
    cut = np.flatnonzero(np.concatenate([ranked[:-1] > ranked[1:], [True]]))
    f1 = 2 * hits[cut] / (seen[cut] + (labels * counts).sum())
    best = cut[np.flatnonzero(f1 >= f1.max() - 1e-12)]
    at = best[len(best) // 2]
    return float((ranked[at] + ranked[at + 1]) / 2) if at + 1 < len(ranked) else float(ranked[at] - 1)


def calibrate(model: Model, logits: np.ndarray, language: np.ndarray, labels: np.ndarray, counts: np.ndarray, enough: int = 8) -> None:
    """Thresholds by language from logits of rows that training did not see, each entry standing for ``counts`` rows.

    A language with few rows of a label takes the common threshold.
    """
    common = best_threshold(logits, labels, counts)
    model.thresholds[:] = 0.0 if common is None else common
    for number in range(len(LANGUAGES) + 1):
        own = language == number
        if (labels * counts)[own].sum() >= enough and ((1 - labels) * counts)[own].sum() >= enough:
            model.thresholds[number] = best_threshold(logits[own], labels[own], counts[own])
    mean = np.average(logits, weights=counts) if len(logits) else 0.0
    spread = float(np.sqrt(np.average((logits - mean) ** 2, weights=counts))) if len(logits) else 1.0
    model.scale = 2.0 / spread if spread > 1e-6 else 1.0
    model.squares = None


def _part(ids: list[int]) -> np.ndarray:
    return np.array([zlib.crc32(f"part{i}".encode()) % FOLDS for i in ids], int)


def _turns(toxic: int, clean: int) -> list[int]:
    """The parts kept back in turn: one, or every one where that leaves few of a label."""
    return [0] if min(toxic, clean) >= 50 else list(range(FOLDS))


def fit_and_calibrate(ids: list[int], texts: list[np.ndarray], labels: np.ndarray, seed: int = 42) -> Model:
    """One part of the rows is kept back for the thresholds; where that leaves few of a label, every part is kept back in turn."""
    part = _part(ids)
    model, logits = None, np.zeros(len(texts))
    turns = _turns(labels[part == 0].sum(), (1 - labels[part == 0]).sum())
    seen = np.isin(part, turns)
    for turn in turns:
        rest = [t for t, p in zip(texts, part) if p != turn]
        model = fit(rest, labels[part != turn], seed)
        own = np.flatnonzero(part == turn)
        logits[own] = model.logits([texts[i] for i in own])
    if len(turns) > 1:
        model = fit(texts, labels, seed)
    language = np.array([guess_language(t[:, 3]) for t, s in zip(texts, seen) if s], int)
    calibrate(model, logits[seen], language, labels[seen], np.ones(int(seen.sum())))
    return model


def _logits_of(rows: DataFrame, model: Model) -> DataFrame:
    """``(language, logit, toxic, n)``: how many of ``rows`` have each logit, to a thousandth."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 1 << 20):
            texts = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch(
                [pa.array([guess_language(t[:, 3]) for t in texts], pa.int32()), pa.array(np.round(shared.value.logits(texts), 3)), batch.column(1)],
                ["language", "logit", "toxic"])

    found = rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(run, "language int, logit double, toxic int")
    return found.groupBy("language", "logit", "toxic").agg(F.count(F.lit(1)).alias("n"))


def fit_and_calibrate_all(rows: DataFrame, some: tuple[list[int], list[np.ndarray], np.ndarray], size: int, seed: int = 42) -> Model:
    """The same over rows that no machine holds, of so many bytes; ``some`` of them, that one does, are where training starts."""
    ids, texts, labels = some
    parted = rows.withColumn("part", F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % FOLDS)
    shards, part = max(1, -(-size // SHARD_BYTES)), _part(ids)

    def fitted(turn: int) -> Model:
        kept = part != turn
        return go_on(fit([t for t, k in zip(texts, kept) if k], labels[kept], seed), parted.where(F.col("part") != turn), shards, seed)

    toxic = {r.toxic: r.n for r in parted.where("part = 0").groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    turns = _turns(toxic.get(True, 0), toxic.get(False, 0))
    model, found = None, []
    for turn in turns:
        model = fitted(turn)
        found += _logits_of(parted.where(F.col("part") == turn), model).collect()  # as many as there are different thousandths
    if len(turns) > 1:
        model = fitted(-1)
    column = lambda name: np.array([r[name] for r in found], float)
    calibrate(model, column("logit"), column("language").astype(int), column("toxic"), column("n"))
    return model


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 42) -> Model | None:
    """A model from all labelled documents that are not held out; None where labels are missing or all alike.

    Rows whose crc32 of the id (as text) leaves remainder 1 modulo 3 never take part.  A document labelled more than once
    is toxic if any label says so.  Up to ``sample_docs`` rows the driver trains alone; of more it takes a hashed sample to start from.
    """
    open_ = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & open_).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    if not total:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = store(texts.join(F.broadcast(known) if total <= BROADCAST_IDS else known, "doc_id"))
    try:
        kinds = labelled.groupBy((F.col("toxic") > 0).alias("toxic")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size")).collect()
        if len(kinds) < 2:
            return None
        n, size = sum(r.n for r in kinds), sum(r["size"] or 0 for r in kinds)
        share = min(1.0, sample_docs / n, SAMPLE_BYTES / max(1, size))
        some = labelled
        if share < 1:
            unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            some = labelled.where(unit < share).distinct()
        found = sorted((r.doc_id, bytes(r.words), r.toxic) for r in some.mapInArrow(_feature_rows, "doc_id long, words binary, toxic int").toLocalIterator())
        words = [np.frombuffer(w, np.int32).reshape(-1, 4) for _, w, _ in found]
        start = [i for i, _, _ in found], words, np.array([t > 0 for _, _, t in found], np.float32)
        return fit_and_calibrate(*start, seed) if share >= 1 else fit_and_calibrate_all(labelled, start, size, seed)
    finally:
        discard(labelled)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            yield pa.record_batch(
                [pa.array([doc_id], pa.int64()), pa.array([features(text.as_py()).tobytes()], pa.binary()), pa.array([toxic], pa.int32())],
                ["doc_id", "words", "toxic"])


def score_column(model: Model | None, text: Column, spark) -> Column:
    """The score of a text column; 0 everywhere without a model.  Null and empty texts are scored like a text without words."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)  # a fixed size: the table and a few filters

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, waiting, size = [], [], 0
        for text in texts:
            waiting.append(features(text))
            size += len(waiting[-1])
            if size > 4 * CHUNK_WORDS:
                out.append(shared.value.scores(waiting))
                waiting, size = [], 0
        if waiting:
            out.append(shared.value.scores(waiting))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``; columns of these names are replaced, repeated rows are all scored.

    ``held_out``: the id's crc32 leaves remainder 1 modulo 3 (never for a null id).  An empty table stays empty.
    """
    model = train(docs, labels, sample_docs)
    own = [c for c in docs.columns if c not in {"held_out", "score", "predicted"}]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = docs.select(*own, held.alias("held_out"), score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    return docs.where(score_column(train(docs, labels, sample_docs), F.col("text"), docs.sparkSession) < THRESHOLD)
