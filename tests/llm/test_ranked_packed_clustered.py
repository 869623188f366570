"""Lexical search, large-item packing and centroid clusters against plain versions on small tables."""

import hashlib
import math
import re

import numpy as np
import pytest

from tracewarden.llm import centroid_clusters, large_item_packing, lexical_search
from tracewarden.llm.catalog import vocabulary_path
from tracewarden.llm.word_bpe import WordIds

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def slow_rank(docs, items, k):
    own = [(i, slow_terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in own:
            m, score = 100 - 50 + (50 * len(t) * n) // total, 0
            for term in set(slow_terms(text)) & set(t):
                tf = t.count(term)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def random_docs(seed, count, words=60):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(f"w{x}" for x in rng.choice(words, rng.integers(1, 30), p=share / share.sum()))) for i in rng.permutation(count)]


ODD = [
    (900, None), (901, ""), (902, " .,;\t"), (903, "Élan élan ÉLAN naïve_x É9"), (904, "w0 " * 5000), (905, "W1 w1-W1"), (None, "w2 w3"), (None, "w2 w3"),
    (3, "w5 w6"), (3, "w5 w6"), (906, "\x00w7\x7fw8{w9}"),
]


@pytest.mark.parametrize("shard_bytes, batch_terms", [(24 << 20, 200_000), (3000, 150)])
def test_search_finds_what_scoring_everything_finds(spark, shard_bytes, batch_terms):
    docs = random_docs(1, 700) + ODD
    items = [(i, t) for i, t in random_docs(2, 25)] + [(50, None), (51, "nowhere"), (52, "élan W0 w0"), (0, "w1 w59"), (0, "w1 w59"), (53, "w2 w7 w8 w9")]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, shard string").repartition(3)
    index = lexical_search.build_index(table, shard_bytes)
    got = lexical_search.search(index, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), 10, batch_terms)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_rank(docs, items, 10)
    assert (index.select("shard").distinct().count() > 10) == (shard_bytes == 3000)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search_documents(docs.limit(0), items).count() == 0
    assert lexical_search.search_documents(docs, items.limit(0)).count() == 0
    assert lexical_search.search_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0


def test_blocks_hold_their_postings_and_maxima():
    docs = random_docs(3, 900, 12)
    rows = [r for b in lexical_search.build_shard(0, [i for i, _ in docs], [t.encode() for _, t in docs]) for r in b.to_pylist()]
    lengths = np.frombuffer(rows[0]["lengths"], "<i8")
    by_id = [t.split() for _, t in sorted(docs)]
    assert rows[0]["ids"] == sorted(i for i, _ in docs) and lengths.tolist() == [len(t) for t in by_id]
    for row in rows[1:]:
        one = lexical_search.PostingList(7, *(row[c] for c in ("lasts", "ends", "pairs", "firsts", "data")), lengths, len(docs), int(lengths.sum()))
        opened = [one.open(b) for b in range(len(one.lasts))]
        word = row["term"].decode()
        want = [d for d, t in enumerate(by_id) if word in t]
        assert np.concatenate([d for d, _ in opened]).tolist() == want and row["df"] == len(want)
        assert [int(s.max()) for _, s in opened] == one.block_best.tolist()


def test_search_leaves_blocks_closed():
    rng = np.random.default_rng(4)
    texts = [("rare " if i in (50, 60, 70) else "") + "common " * int(rng.integers(1, 3)) + " ".join(f"x{rng.integers(1000)}" for _ in range(20)) for i in range(20_000)]
    rows = [r for b in lexical_search.build_shard(0, list(range(20_000)), [t.encode() for t in texts]) for r in b.to_pylist()]
    lengths = np.frombuffer(rows[0]["lengths"], "<i8")
    lists = [
        lexical_search.PostingList(w, *(next(r for r in rows if r["term"] == t)[c] for c in ("lasts", "ends", "pairs", "firsts", "data")), lengths, 20_000, int(lengths.sum()))
        for t, w in ((b"rare", 9000), (b"common", 3))]
    doc, _ = lexical_search.best_of_shard(lists, 20_000, 3)
    assert sorted(doc.tolist()) == [50, 60, 70]
    assert len(lists[1].opened) < 0.3 * len(lists[1].lasts)


def test_wide_values_survive_compression():
    n = 70_000
    texts = [b"a " * (70_000 if i == 0 else 300) if i in (0, n - 1) else b"b" for i in range(n)]
    rows = {r["term"]: r for b in lexical_search.build_shard(0, list(range(n)), texts) for r in b.to_pylist()}
    doc, tf = lexical_search.unpack(rows[b"a"]["data"], 2, -1)
    assert doc.tolist() == [0, n - 1] and tf.tolist() == [70_000, 300]


def slow_pack(lengths, capacity):
    """The same rules one piece at a time; gives the number of sequences."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        first = large.pop(0)
        partner = next((j for j, n in enumerate(large) if first + n <= capacity), None)
        gaps.append(capacity - first - (large.pop(partner) if partner is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def unfold(counts, runs, capacity):
    """Fill of every sequence after checking that every rank has one place and that offsets have no gaps."""
    places = {}
    by_length = {}
    for run in sorted(runs):
        by_length.setdefault(run.length, []).append(run)
    for n, count in counts.items():
        own = by_length[n]
        for run, end in zip(own, [r.first for r in own[1:]] + [count]):
            for rank in range(run.first, end):
                step = rank - run.first
                places.setdefault(run.sequence + step // run.each, []).append((run.offset + step % run.each * n, n))
    fills = {}
    for sequence, pieces in places.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in pieces) <= 2
        fills[sequence] = at
    return fills


def test_plan_of_runs_is_the_plan_of_pieces():
    rng = np.random.default_rng(5)
    cases = [[], [100], [50] * 7, [34] * 5, [33] * 10, [1] * 1000, [51] * 9 + [49] * 4, rng.integers(1, 101, 500).tolist(), rng.integers(1, 40, 500).tolist(),
             rng.integers(30, 70, 400).tolist(), [40] * 333 + rng.integers(1, 101, 300).tolist()]
    for lengths in cases:
        counts = {int(n): lengths.count(n) for n in set(lengths)}
        runs, sequences = large_item_packing.plan(counts, 100)
        fills = unfold(counts, runs, 100)
        assert sorted(fills) == list(range(sequences))
        assert sequences == slow_pack(lengths, 100) and sum(fills.values()) == sum(lengths)


def test_plan_stays_small_and_tight():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(6, 1, 2_000_000).astype(int) + 1, 4096)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    runs, sequences = large_item_packing.plan(counts, 4096)
    assert len(runs) < 40_000 and sequences <= 1.001 * math.ceil(lengths.sum() / 4096)


def test_packed_rows(spark):
    texts = ["one two three", "", None, "long " * 9000, "one two three", "word " * 1500, "word " * 1500, "x " * 2047, "x " * 2048, "tail " * 4095]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "one two three"), (None, "no id"), (None, None)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(3)
    out = large_item_packing.pack(table, vocabulary_path(), 1).toPandas()
    words, end = WordIds(vocabulary_path()), np.array([1], "<u4").tobytes()
    whole = {i: words.encode(t) + end for i, t in rows if i}
    for key, own in out[out.doc_id > 0].sort_values("start").groupby("doc_id"):
        assert b"".join(own.ids) == whole[int(key)] and (own.doc_tokens == len(whole[int(key)]) // 4).all()
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [4096 * i for i in range(len(own))]
        assert (own.length.iloc[:-1] == 4096).all()
    total = sum(len(words.encode(t) + end) // 4 for _, t in rows)
    assert out.length.sum() == total and (out.doc_id == 0).sum() == 2 and out.doc_id.isna().sum() == 2
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist() and own.length.sum() <= 4096
    assert out.sequence_id.nunique() == slow_pack(out.length.tolist(), 4096)
    assert large_item_packing.pack(table.limit(0), vocabulary_path(), 1).count() == 0


def slow_nearest(points, centroids):
    away = ((points[:, None, :] - centroids[None]) ** 2).sum(2)
    return away.argmin(1), away.min(1)


def slow_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    points = np.array([v for _, v in kept], dtype=np.int64)
    first = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"1:{'null' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))[:k]
    centroids = points[first]
    for _ in range(rounds):
        number, _ = slow_nearest(points, centroids)
        for c in range(len(centroids)):
            own = points[number == c]
            if len(own):
                centroids[c] = own.sum(0) // len(own)
    number, distance = slow_nearest(points, centroids)
    digest = [hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest() for c in centroids.tolist()]
    return sorted(((i, int(c), int(d), int(distance[number == c].sum()), int(distance.sum()), digest[c]) for (i, _), c, d in zip(kept, number, distance)), key=str)


def test_nearest_centroid_is_exact_with_ties():
    rng = np.random.default_rng(7)
    for d, spread, k in ((64, 30, 16), (4, 3, 40), (2, 1, 9), (64, 1 << 27, 16), (3, 2, 1)):
        points, centroids = rng.integers(-spread, spread + 1, (500, d)), rng.integers(-spread, spread + 1, (k, d))
        centroids[-1] = centroids[0]
        index = centroid_clusters.EqualAverageIndex(centroids)
        number, distance = index.nearest(points)
        want = slow_nearest(points, centroids)
        assert number.tolist() == want[0].tolist() and distance.tolist() == want[1].tolist()


def test_bounds_spare_comparisons():
    rng = np.random.default_rng(8)
    centroids = rng.integers(-20, 20, (64, 64)) + 40 * np.arange(64)[:, None]
    points = centroids[rng.integers(0, 64, 1000)] + rng.integers(-3, 4, (1000, 64))
    index = centroid_clusters.EqualAverageIndex(centroids)
    assert (index.nearest(points)[0] == slow_nearest(points, centroids)[0]).all() and index.compared < 3000


def test_clusters_of_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=64).round(2)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(200)] + [(4, rows[4][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 63 + [None]), (604, [float("nan")] * 64), (605, [float("inf")] + [0.0] * 63), (606, [0.0] * 64)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = sorted((tuple(r) for r in centroid_clusters.cluster(table).collect()), key=str)
    assert got == slow_clusters(rows, 16, 3)
    few = table.where("vec_id < 3")
    assert sorted((tuple(r) for r in centroid_clusters.cluster(few).collect()), key=str) == slow_clusters(rows[:3], 16, 3)
    assert centroid_clusters.cluster(table.where("vec_id > 599 and vec_id < 606")).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert {r.distance for r in centroid_clusters.cluster(huge).collect()} == {0}
