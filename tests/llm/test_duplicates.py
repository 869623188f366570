"""SimHash classes, repeated strings and I-Match fingerprints against brute force."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from tracewarden.llm import imatch, induced_sort, simhash, suffix_dedup

# ---- SimHash


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, bits=4):
    labels = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= bits and labels[i] != labels[j]:
                    labels[i] = labels[j] = min(labels[i], labels[j])
                    changed = True
    return [min((ids[j] for j in range(len(fps)) if labels[j] == labels[i] and ids[j] is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("limit", [20_000, 5])
def test_near_copies_match_brute_force(spark, limit):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(25)]
    texts = [*base, *base[:5], None, "", " \t", "One", "one", "two words", "ÄÖ mixed CASE here now"]
    for text in base:
        edited = text.split()
        edited[rng.randrange(len(edited))] = "changed"
        texts += [" ".join(edited), text + " tail"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "alone and without an id of its own"), (3, base[1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_copies(docs, group_limit=limit).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t in rows]
    want = slow_components(fps, [i for i, _ in rows])
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want)], key=key)
    kept = simhash.keep_one(docs, group_limit=limit).collect()
    assert len(kept) == len(set(slow_components(fps, list(range(len(rows))))))
    assert Counter(r.doc_id for r in kept) == Counter(set(want))
    assert simhash.near_copies(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_group_index_finds_all_links():
    rng = np.random.default_rng(4)
    centers = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    fps = set(centers.tolist())
    for center in centers:
        word = int(center)
        for _ in range(60):  # chains of small steps
            word ^= sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 6))})
            fps.add(word)
    fps = np.fromiter(sorted(fps), np.uint64, len(fps))
    first = simhash.group_components(fps, 4)
    want = slow_components([int(f) for f in fps], list(range(len(fps))))
    assert Counter(zip(first.tolist(), want)).keys() == set(zip(first.tolist(), want)) and len(set(first.tolist())) == len(set(want)) == len(set(zip(first.tolist(), want)))


def test_components_of_a_long_chain(spark):
    n = 300
    rng = random.Random(5)
    names = rng.sample(range(-10_000, 10_000), n)
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(n - 1)] + [(names[0], names[0])], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {x: min(names) for x in names}


# ---- repeated strings

def flags_by_counting(pieces, depth):
    counts = Counter(p[i:i + depth] for p in pieces for i in range(len(p) - depth + 1))
    return [[counts[p[i:i + depth]] > 1 for i in range(len(p) - depth + 1)] for p in pieces]


@pytest.mark.parametrize("small, chunk, memory", [(0, 7, 300), (12, 1 << 18, 1 << 20), (12, 64, 2000)])
def test_induced_sort_matches_counting(monkeypatch, small, chunk, memory):
    monkeypatch.setattr(induced_sort, "SMALL", small)
    monkeypatch.setattr(induced_sort, "CHUNK", chunk)
    rng = random.Random(6)
    for _ in range(250):
        letters, depth = rng.choice([1, 2, 3, 26]), rng.choice([1, 2, 3, 8, 20, 40])
        base = bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randrange(0, 150)))
        pieces = []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(0, len(base) + 1)
            pieces.append(base[a:rng.randrange(a, len(base) + 1)] + bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randrange(0, 30))) + b"\xc3\xa9" * rng.randrange(3))
        flags, at = induced_sort.repeated_starts(pieces, depth, memory), 0
        for piece, want in zip(pieces, flags_by_counting(pieces, depth)):
            assert flags[at:at + len(want)].tolist() == want
            at += len(piece) + 1


def slow_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if counts[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("shard, limit", [(8 << 20, 30_000), (500, 3)])
def test_removal_matches_brute_force(spark, shard, limit):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "zeta"]
    passage = " ".join(rng.choices(words, k=20))
    texts = [None, "", "short", "a" * 900, "ab" * 300, passage, passage, "x" + passage, passage * 3]
    for _ in range(60):
        body = " ".join(rng.choices(words, k=rng.randrange(1, 60)))
        texts.append(body if rng.random() < 0.5 else body[:30] + passage + body[30:])
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a" * 900), (5, texts[40]), (None, texts[41]), (None, passage)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "mine") for i, t in rows], "doc_id long, text string, n_chars long, kept string")
    got = suffix_dedup.remove_repeats(docs, length=40, window=8, shard_bytes=shard, key_limit=limit).collect()
    want = [(i, *w) for (i, _), w in zip(rows, slow_removal([t for _, t in rows], 40))]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=key) == sorted(want, key=key)
    clean = suffix_dedup.clean(docs, length=40, window=8)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in clean.collect() if r.text is not None)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# ---- I-Match

def test_repeated_rows_cost_one(spark):
    text = " ".join(f"word{i}" for i in range(500))
    rows = [(7, text)] * 1600 + [(8, "before " + text[:900]), (9, "short"), (9, "short"), (None, text + " and more"), (10, "alone " * 3)]
    started = time.time()
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert time.time() - started < 60 and len(got) == len(rows)
    whole = {(r.doc_id, r.n_removed, r.n_spans) for r in got}
    assert whole == {(7, len(text), 1), (8, 900, 1), (9, 0, 0), (None, len(text), 1), (10, 0, 0)}


def test_keys_with_many_bytes_are_counted(spark):
    rows = [(i, chr(97 + i % 2) * (3000 + i)) for i in range(12)] + [(20, "x" * 50)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, *w) for (i, _), w in zip(rows, slow_removal([t for _, t in rows], 40))]
    got = suffix_dedup.remove_repeats(table, 40, 8, key_bytes=1000).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


def test_fingerprints_tell_edits_from_strangers(spark):
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(common, k=60) + rng.choices(rare, k=60))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, rows[5][1]), (303, "unseen"), (304, "w " * 50_000), (None, "no id"), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, run string")
    lexicon = imatch.build_lexicon(docs)
    assert "c1" not in lexicon and "r1" in lexicon
    got = imatch.compare_with_edit(docs, lexicon).collect()
    assert len(got) == len(rows)
    texts = sorted(((-1 if i is None else i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    following = [texts[(k + 1) % len(texts)][1] for k in range(len(texts))]
    want = sorted((i, len(t), hashlib.sha256((t[:len(t) - len(t) // 3] + n[:len(t) // 3]).encode()).hexdigest()) for (i, t), n in zip(texts, following))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    marks = {}
    for r in got:
        marks.setdefault(next(t or "" for i, t in rows if i == r.doc_id), set()).add(r.fingerprint)
    assert all(len(m) == 1 for m in marks.values())
    own = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.near_edited for r in own]) > 0.3 and np.mean([r.near_next for r in own]) < 0.05
    assert imatch.compare_with_edit(docs.limit(0), lexicon).count() == 0


def test_single_document_is_its_own_next(spark):
    docs = spark.createDataFrame([(1, "abcdef ghi")], "doc_id long, text string")
    row = imatch.compare_with_edit(docs, []).first()
    assert row.near_next == 1.0 and row.n_chars == 10


def test_signatures_by_hand():
    lexicon = imatch.Lexicon.of(["a", "b", "c", "d", "e"])
    text = "e d c b a a"
    level = (5).bit_length() - 1
    for part, each in zip(lexicon.fingerprint(text).split("|"), (level, level + 1)):
        assert part.startswith(f"{each}:")
        for s in range(imatch.SUBSETS):
            inside = [t for t in "abcde" if lexicon.depths[t][s] >= each]
            want = hashlib.blake2b(" ".join(inside).encode(), digest_size=3).hexdigest() if inside else "------"
            assert part.split(":")[1][6 * s:6 * s + 6] == want


def test_runs_are_hashed_in_small_chunks_and_freed_memory_is_given_back(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tracewarden.llm import common, suffix_dedup
    released = []

    class Pool:
        def release_unused(self):
            released.append(1)

    text = np.random.default_rng(9).integers(97, 123, 10_000).astype(np.uint8).tobytes()
    batch = pa.record_batch([pa.array(range(100)), pa.array(range(100)), pa.array([text] * 100, pa.binary())], ["place", "check", "bytes"])
    with monkeypatch.context() as patched:
        patched.setattr(common.pa, "default_memory_pool", Pool)
        parts = list(suffix_dedup._runs(200, suffix_dedup.WINDOW)([batch]))
    assert released  # also in a worker that kept nothing
    assert len(parts) >= len(text) * 100 // suffix_dedup.RUN_BYTES
    whole = suffix_dedup.key_runs([text] * 100, 200, suffix_dedup.WINDOW)
    assert np.array_equal(np.concatenate([p.column(0).to_numpy() for p in parts]), whole[3])
    assert np.array_equal(np.concatenate([p.column(3).to_numpy() for p in parts]), whole[1])
