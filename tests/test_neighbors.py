import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import neighbors, vector_index
from tracewarden.operators.lof import local_outlier_factor
from tracewarden.operators.neighbors import knn_join


def brute(x, y, k, metric="l2", exclude_self=False):
    out = set()
    for i, q in enumerate(x):
        if metric == "l2":
            d = np.sqrt(((y - q) ** 2).sum(axis=1))
        else:
            d = 1 - (y @ q) / (np.linalg.norm(y, axis=1) * np.linalg.norm(q))
        order = [j for j in np.lexsort((np.arange(len(y)), np.round(d, 12))) if not (exclude_self and j == i)][:k]
        out |= {(i, int(j), r + 1, round(float(d[j]), 9)) for r, j in enumerate(order)}
    return out


def rows(df):
    return {(r["query_id"], r["neighbor_id"], r["rank"], round(r["distance"], 9)) for r in df.collect()}


@pytest.mark.parametrize("block_rows", [10_000, 150, 40])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_matches_brute_force(vectors, block_rows, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) + rng.integers(0, 4, size=(400, 1)) * 5
    df = vectors(x)
    assert rows(knn_join(df, df, 4, metric=metric, block_rows=block_rows, few_queries=0)) == brute(x, x, 4, metric, exclude_self=True)


@pytest.mark.parametrize("block_rows", [10_000, 60])
def test_knn_with_a_third_of_copies(vectors, block_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[100:200] = x[100]
    x[250:260] = x[250]
    df = vectors(x)
    assert rows(knn_join(df, df, 3, block_rows=block_rows, few_queries=0)) == brute(x, x, 3, exclude_self=True)


def test_knn_between_two_tables(vectors):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(90, 4))
    got = knn_join(vectors(a), vectors(b), 5, exclude_self=False, block_rows=25)
    assert rows(got) == brute(a, b, 5)


def test_corpus_too_large_to_send(vectors, monkeypatch):
    from tracewarden.operators import neighbors
    x = np.random.default_rng(5).normal(size=(80, 3))
    df = vectors(x)
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 10)
    assert rows(knn_join(df, df, 4)) == brute(x, x, 4, exclude_self=True)


def test_unknown_metric(vectors):
    df = vectors(np.eye(3))
    with pytest.raises(ValueError):
        knn_join(df, df, 1, metric="l1")


def test_lof_golden(vectors):
    df = vectors(np.array([[0.0], [1.0], [2.0], [3.0], [10.0]]))
    got = [r["lof"] for r in local_outlier_factor(df, 2).orderBy("row_id").collect()]
    assert np.allclose(got, [1, 1, 1, 1, 5], atol=1e-6)


def test_lof_with_fewer_rows_than_neighbors(vectors):
    df = vectors(np.array([[0.0], [1.0], [3.0]]))
    assert local_outlier_factor(df, 20).where(F.col("lof").isNull()).count() == 0


@pytest.mark.parametrize("block", [10_000, 4])
@pytest.mark.parametrize("own", [True, False])
def test_cosine_with_zero_vectors(vectors, block, own):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(20, 4)), np.zeros((5, 4)), rng.normal(size=(1, 4)) * 1e6])
    got = {}
    for r in knn_join(vectors(x), vectors(x), 3, "cosine", exclude_self=own, block_rows=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    norms = np.linalg.norm(x, axis=1)
    for i in range(len(x)):
        distance = [1 - float(x[i] @ x[j]) / (norms[i] * norms[j]) if norms[i] * norms[j] else 1.0 for j in range(len(x))]
        want = sorted((round(d, 12), j) for j, d in enumerate(distance) if not own or j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want], i


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_few_queries_travel_to_the_corpus(vectors, metric):
    rng = np.random.default_rng(41)
    x = rng.normal(size=(900, 4)) + 2
    x[300:600] = x[300]  # a third of equal rows
    corpus, queries = vectors(x).repartition(5), vectors(x[[0, 5, 300, 301, 899]])
    got = knn_join(queries, corpus, 4, metric=metric, exclude_self=False, block_rows=50)
    assert rows(got) == brute(x[[0, 5, 300, 301, 899]], x, 4, metric)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = plan.rsplit("MapInPandas", 1)[1]
    assert "Exchange hashpartitioning" not in scans and "Sort" not in scans  # nothing below the corpus pass


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_finds_what_a_join_finds(spark, vectors, tmp_path, metric):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(1200, 3)) + rng.integers(0, 6, size=(1200, 1)) * 9
    x[100:300] = x[100]
    if metric == "cosine":
        x[500:505] = 0
    corpus = vectors(x).withColumn("line", F.col("row_id").cast("string"))
    folder = vector_index.build(corpus.where("row_id < 700"), str(tmp_path / "index"), metric, rows_per_cell=60)
    vector_index.append(corpus.where("row_id >= 700"), folder)
    asked = corpus.where("row_id in (0, 100, 299, 502, 800, 1199)")
    got = vector_index.search(asked, folder, 5)
    want = knn_join(asked, corpus, 5, metric=metric, exclude_self=False)
    assert rows(got) == rows(want)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    one = vector_index.search(corpus.where("row_id = 800"), folder, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[(.*?)\], ", plan)[1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "100")
    wanted = re.search(r"cell#\d+ (?:IN \(([^)]*)\)|INSET ([-\d, ]+)|= (-?\d+))", pruned)
    assert wanted, pruned
    cells = vector_index.open_rows(spark, folder).select("cell").distinct().count()
    assert len((wanted[1] or wanted[2] or wanted[3]).split(",")) <= (cells / 2 if metric == "l2" else cells)
    many = vector_index.search(corpus, folder, 2, exclude_self=True)
    assert rows(many) == rows(knn_join(corpus, corpus, 2, metric=metric))
    assert "line" in vector_index.open_rows(spark, folder).columns


def test_index_without_finished_batches_is_not_read(spark, vectors, tmp_path):
    rng = np.random.default_rng(43)
    corpus = vectors(rng.normal(size=(50, 3)))
    folder = vector_index.build(corpus.where("row_id < 25"), str(tmp_path / "index"))
    corpus.where("row_id >= 25").select("row_id", "embedding", F.lit(0.0).alias("away"), F.lit("broken").alias("batch"), F.lit(0).alias("cell")).write.partitionBy(
        "batch", "cell").mode("append").parquet(f"{folder}/rows")
    assert vector_index.open_rows(spark, folder).count() == 25
    empty = vector_index.build(corpus.limit(0), str(tmp_path / "empty"))
    assert vector_index.search(corpus.limit(2), empty, 3).count() == 0


def test_rows_leave_for_many_cells_in_bounded_batches():
    from types import SimpleNamespace

    import pyarrow as pa

    from tracewarden.operators import neighbors
    x = np.random.default_rng(6).normal(size=(3000, 64))
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(x))), "v": pa.array(list(x), pa.list_(pa.float64()))})
    reach = SimpleNamespace(value=np.full(200, np.inf))
    sent = seen = 0
    for out in neighbors._send(SimpleNamespace(value=x[:200]), reach, "l2", False)([batch]):
        assert 8 * 64 * len(out) <= neighbors.SENT_BYTES
        sent, seen = sent + len(out), seen + sum(out.column("id").to_pylist())
    assert sent == 200 * 3000 and seen == 200 * 3000 * 2999 // 2  # every row went to every cell


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vectors_without_structure_go_to_few_blocks(vectors, monkeypatch, metric):
    from tracewarden.operators import neighbors
    tried = []
    pivots_of = neighbors._pivots_of
    monkeypatch.setattr(neighbors, "_pivots_of", lambda c, n, wanted, m: tried.append(wanted) or pivots_of(c, n, wanted, m))
    x = np.random.default_rng(7).normal(size=(600, 24))
    df = vectors(x)
    assert rows(knn_join(df, df, 3, metric=metric, block_rows=10, few_queries=0)) == brute(x, x, 3, metric, exclude_self=True)
    assert tried == [120, neighbors.MAX_BLOCKS]
    tried.clear()
    far = np.random.default_rng(8).normal(size=(600, 3)) + 1000.0 * np.arange(600)[:, None].repeat(3, 1) // 20 * 20
    knn_join(vectors(far), vectors(far), 3, block_rows=10, few_queries=0)
    assert tried == [120]  # the bounds hold most rows back here


def test_block_size_is_bounded_by_bytes():
    from tracewarden.operators import neighbors
    assert neighbors.block_size(1_000, 64, 200, 16) == 200
    assert neighbors.block_size(100_000, 64, 200, 16) == 6_250
    assert neighbors.block_size(10**9, 64, 200, 16) * 64 * 8 == neighbors.BLOCK_BYTES


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_block_is_searched_by_slices_of_the_corpus(monkeypatch, metric):
    monkeypatch.setattr(neighbors, "CORPUS_SLICE", 16)
    monkeypatch.setattr(neighbors, "QUERY_SLICE", 8)
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, (150, 3)).astype(float)  # many ties and copies, zero vectors too
    points[:40] += 1e6
    ids = rng.permutation(150)
    seen = []
    partition = np.partition
    monkeypatch.setattr(neighbors.np, "partition", lambda a, *rest, **more: seen.append(a.shape) or partition(a, *rest, **more))
    got = neighbors.block_top_k(ids, points, ids, points, 5, metric, True)
    for i, own in enumerate(ids):
        distance = neighbors.exact_distances(np.repeat(points[i:i + 1], 150, axis=0), points, metric)
        want = [(int(o), d) for d, o in sorted(zip(distance, ids)) if o != own][:5]
        mine = got[got["query_id"] == own].sort_values("rank")
        assert list(zip(mine["neighbor_id"], mine["distance"])) == want
    assert max(rows * columns for rows, columns in seen) <= 8 * 16  # only a slice is put in order, not queries x corpus
