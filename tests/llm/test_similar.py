"""The pipeline's near-copy stage against exact similarities of all pairs."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from tracewarden.llm import similar, simhash

SF = "/root/testdata/sf0.001"


def slow_groups(texts):
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    labels, linked = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                linked += texts[i] != texts[j]
                a, b = max(labels[i], labels[j]), min(labels[i], labels[j])
                labels = [b if x == a else x for x in labels]
    return labels, linked


@pytest.mark.parametrize("rounds", [3, 0])
def test_stage_keeps_one_of_similar_texts(spark, monkeypatch, rounds):
    monkeypatch.setattr(similar, "STAR_ROUNDS", rounds)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t", "One", "one", "two words"]
    for n in (12, 40, 90, 150, 300, 600):
        for _ in range(8):
            text = rng.choices(words, k=n)
            texts += [" ".join(text), " ".join(text)]
            for part in (0.01, 0.02, 0.03):
                edited = list(text)
                for at in rng.sample(range(n), max(1, int(part * n))):
                    edited[at] = rng.choice(words)
                texts.append(" ".join(edited))
            texts.append(" ".join(text[:int(n * 0.85)]))
    want, linked = slow_groups(texts)
    assert linked > 100
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_distance_is_wide_enough():
    rng = np.random.default_rng(7)
    for n in (4, 8, 9, 40, 200):
        away = []
        for _ in range(2000):
            hashes = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n, np.uint64))
            rest = max(1, n // 9)  # shared n - rest of n each, about 0.8
            pair = (hashes[:n], hashes[:n + n // 4]) if n < 9 else (hashes[:n], np.concatenate([hashes[rest:n], hashes[n:n + rest]]))
            away.append((simhash.majority(pair[0]) ^ simhash.majority(pair[1])).bit_count())
        assert max(away) <= similar.WIDE_BITS


def test_no_link_is_lost(spark, monkeypatch):
    monkeypatch.setattr(similar, "WIDE_BITS", 0)  # as if all fingerprints were far apart
    texts = []
    for seed in (159, 5460):  # pairs at exactly 0.8 that bands of least hashes do not bring together
        words = [f"w{(seed * 131 + i * i * 7 + i * seed) % 100003}" for i in range(14)]
        texts += [" ".join(words[:12]), " ".join(words)]
    rng = random.Random(5)
    for n in (10, 30, 200):
        for _ in range(20):
            words = [f"x{rng.randrange(10**6)}" for _ in range(n + 4)]
            texts += [" ".join(words[:int(0.8 * n) + 4]), " ".join(words)]
    want, linked = slow_groups(texts)
    assert linked >= 42
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == sorted(set(want))


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(3)
    for n in (*range(1, 30), 100, 333):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n + 5, np.uint64))
            rng.shuffle(pool)
            m = rng.integers(n, int(n / similar.LIKENESS + 1e-9) + 1)
            both = int(np.ceil(similar.LIKENESS * (n + m) / (1 + similar.LIKENESS) - 1e-9))
            if both > n:
                continue
            one, other = np.sort(pool[:n]), np.sort(pool[n - both:n - both + m])
            known = np.sort(rng.choice(pool, len(pool) // 2, replace=False))
            for common in ((known[:0], known[:0]), (known, rng.integers(1, 9, len(known)))):
                keys = [similar.prefix_keys(x, common) for x in (one, other)]
                assert len(np.intersect1d(*keys)) and len(keys[0]) == n - int(np.ceil(0.8 * n - 1e-9)) + 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")
def test_stage_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want, _ = slow_groups([t for _, t in rows])
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == [rows[i][0] for i in sorted(set(want))]


def test_links_that_are_stars_need_no_round(spark, monkeypatch):
    stored, store = [], simhash.store
    monkeypatch.setattr(simhash, "store", lambda df: stored.append(1) or store(df))
    edges = lambda *pairs: spark.createDataFrame(pairs, "a long, b long")
    got = {(r.node, r.root) for r in simhash.components(edges((1, 2), (3, 1), (9, 8), (1, 2), (5, 5))).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)} and len(stored) == 1
    chain = {(r.node, r.root) for r in simhash.components(edges(*((i, i + 1) for i in range(20)))).collect()}
    assert chain == {(i, 0) for i in range(21)}
    assert not simhash.components(edges((4, 4))).collect()


def test_groups_hand_on_few_pairs_that_are_no_links(spark, monkeypatch):
    monkeypatch.setattr(similar, "STAR_ROUNDS", 0)
    tried, confirmed = [], similar._confirmed
    monkeypatch.setattr(similar, "_confirmed", lambda pairs, sets: tried.append(pairs.count()) or confirmed(pairs, sets))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage, texts = rng.choices(words, k=120), []
    for _ in range(150):  # copies of one passage, too far apart to be linked but for the pairs made here
        copy = list(passage)
        for at in rng.sample(range(120), 5):
            copy[at] = rng.choice(words)
        texts += [" ".join(copy), " ".join([*copy[:119], rng.choice(words)])]
    want, linked = slow_groups(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == sorted(set(want))
    assert linked >= 150 and linked <= sum(tried) <= 2 * linked + 100


def test_counts_differ_no_more_than_the_sets():
    rng = np.random.default_rng(9)
    for n in (1, 40, 3000, 200_000):
        hashes = np.unique(rng.integers(0, 1 << 63, n + n // 8 + 1, np.uint64))
        one, other = hashes[:n], hashes[len(hashes) - n:]
        gap = np.abs(similar.cell_counts(one).astype(int) - similar.cell_counts(other)).sum()
        assert gap <= len(np.setxor1d(one, other))
    few = np.arange(1, 400, dtype=np.uint64) << np.uint64(1)
    counts = np.stack([similar.cell_counts(few[a:b]) for a, b in ((0, 100), (0, 80), (0, 79), (150, 250))])
    sizes = np.array([100, 80, 79, 100], np.int32)
    allowed = similar._counts_allow(counts, sizes, np.zeros(3, int), np.arange(1, 4))
    assert allowed.tolist() == [True, False, False]
