"""Multi-index search against brute force, the pipeline stage by stage."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewarden.llm import multi_index, suffix_dedup

from .test_similar import slow_groups

SF = "/root/testdata/sf0.001"


def slow_search(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        vector = next(v for i, v in usable if i == q)
        best = {}
        for i, v in usable:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float((v * vector).sum()))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("block", [4096, 9])
def test_search_of_everything_is_exact(spark, block):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # equal vectors: ties go to the smaller id
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (320, [float("inf")] * 6), (305, [1.0]), (None, [1.0] * 6), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    got = multi_index.search(table, every=20, k=20, centroids=4, share=1.0, block_rows=block).collect()
    want = slow_search(rows, 20, 20)
    assert [tuple(r) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(q, r, i, pytest.approx(s, abs=1e-12)) for q, r, i, s in want]


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in multi_index.search(table).collect()}
    want = {(q, i) for q, _, i, _ in slow_search(rows, 20, 20)}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("spread", [None, 0.0, 0.002])
def test_recall_beside_a_dense_spot(spark, spread):
    rng = np.random.default_rng(12)
    matrix = rng.normal(size=(6000, 64)) / np.sqrt(64)
    if spread is not None:  # a third of the rows are equal, or nearly so
        matrix = np.concatenate([matrix, matrix[7] + spread * rng.normal(size=(3000, 64))])[rng.permutation(9000)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in multi_index.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in range(0, len(matrix), 20):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(scores)), -scores.round(12)))[:20]
        if np.sort(np.linalg.norm(matrix - matrix[q], axis=1))[500] > 0.1:
            shares.append(len(found[q] & set(best.tolist())) / 20)  # of queries outside the spot
    assert len(shares) > 200 and np.mean(shares) >= 0.9


@pytest.mark.parametrize("n", [2, 10, 25, 40])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    rows += [(1, [float(x) for x in rng.normal(size=6)]) for _ in range(30)]  # many vectors of one id are one candidate
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in sorted(multi_index.search(table, every=1).collect(), key=lambda r: (r.query_id, r.rank))]
    per_query = {}
    for q, rank, i, _ in got:
        per_query.setdefault(q, []).append((rank, i))
    assert sorted(per_query) == list(range(n))
    for q, found in per_query.items():
        assert [r for r, _ in found] == list(range(1, min(20, n - 1) + 1)) and len({i for _, i in found} - {q}) == len(found)
        if n <= 21:
            assert {i for _, i in found} == set(range(n)) - {q}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables not here")
def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    matrix, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    found = {}
    for r in multi_index.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for at in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[at]
        scores[at] = -np.inf
        shares.append(len(found[ids[at]] & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    assert np.mean(shares) >= 0.9


def test_search_of_nothing(spark):
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert multi_index.search(table).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert multi_index.search(one).count() == 0


def test_walk_takes_pairs_in_order():
    rng = np.random.default_rng(11)
    left, right, sizes = rng.normal(size=5), rng.normal(size=4), rng.integers(0, 3, 20)
    cells = multi_index.walk(left, right, sizes, 10**6)
    sums = [left[c // 4] + right[c % 4] for c in cells]
    assert sums == sorted(sums, reverse=True) and set(cells) == set(np.flatnonzero(sizes).tolist())
    few = multi_index.walk(left, right, sizes, 5)
    assert few == cells[:len(few)] and sizes[few].sum() >= 5 > sizes[few[:-1]].sum()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        if name in ("toxicity", "near_copies"):
            assert after.exceptAll(before).count() == 0
        if name == "near_copies":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            groups, _ = slow_groups([t for _, t in rows])
            assert sorted(r.doc_id for r in after.collect()) == [rows[i][0] for i in sorted(set(groups))]
        if name == "suffix_dedup":
            assert after.count() == before.count()
            assert suffix_dedup.remove_repeats(before).agg(F.sum("n_removed")).first()[0] > 0 or after.exceptAll(before).count() == 0
        if name == "mixing":
            assert after.select(*columns).distinct().exceptAll(before.distinct()).count() == 0
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert pieces.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, SF).columns == pieces.columns


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_stage_runs_in_a_session_that_has_run_the_query(spark):
    docs = spark.createDataFrame([(1, "c" * 300), (2, "d" + "c" * 300)], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] == 600
    assert sorted(r.text for r in suffix_dedup.clean(docs).collect()) == ["", "d"]


def test_repeats_are_cut_and_decoded_in_one_worker(spark):
    from tracewarden.llm import suffix_dedup

    shared = "\u00e4b" * 150
    docs = spark.createDataFrame([(1, "one " + shared, 0), (2, "two " + shared + " end", 0), (3, None, 0)], "doc_id long, text string, n_chars long")
    done = suffix_dedup.clean(docs)
    assert [tuple(r) for r in done.orderBy("doc_id").collect()] == [(1, "one", 3), (2, "two end", 7), (3, None, None)]
    assert done._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
