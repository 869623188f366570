import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import extra_trees, metrics, supervised
from tracewarden.operators.silhouette import centroid_silhouette, silhouette
from tracewarden.sources import loaders


def test_binary_golden(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [1, 0, 0, 1, 1])), "label int, pred int")
    r = metrics.binary_metrics(rows).first()
    assert r["accuracy"] == pytest.approx(0.6) and r["far"] == pytest.approx(0.5)
    assert r["precision"] == r["recall"] == r["f1"] == r["dr"] == pytest.approx(2 / 3)
    none = metrics.binary_metrics(rows.where("label = 0 AND pred = 0")).first()
    assert (none["precision"], none["recall"], none["f1"], none["dr"], none["accuracy"]) == (0, 0, 0, 0, 1)


def test_ranking_golden(spark):
    y, s = [0, 0, 1, 1, 1, 0, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.8, 0.8, 0.2, 0.05]
    r = metrics.ranking_metrics(spark.createDataFrame(list(zip(y, s)), "label int, score double")).first()
    assert r["roc_auc"] == pytest.approx(0.6875) and r["average_precision"] == pytest.approx(0.65)
    one = metrics.ranking_metrics(spark.createDataFrame([(1, 0.5), (1, 0.6)], "label int, score double")).first()
    assert one["roc_auc"] == 0.0


def test_cluster_quality_golden(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [5.0, 5.0], 1), (3, [5.0, 7.0], 1), (4, [50.0, 50.0], -1)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, cluster_id int")
    assert silhouette(df).first()[0] == pytest.approx(0.797776, abs=1e-6)
    assert silhouette(df, block_rows=2).first()[0] == pytest.approx(0.797776, abs=1e-6)
    assert metrics.davies_bouldin(df).first()[0] == pytest.approx(0.201802, abs=1e-6)
    one = df.where("cluster_id <> 1")
    assert silhouette(one).first()[0] is None and metrics.davies_bouldin(one).first()[0] is None


def test_centroid_silhouette(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(60, 3)), rng.integers(-1, 3, 60)
    x, c = np.vstack([x, [[9.0, 9, 9]]]), np.append(c, 7)
    df = spark.createDataFrame([(i, [float(e) for e in v], int(k)) for i, (v, k) in enumerate(zip(x, c))], "row_id long, embedding array<double>, cluster_id int")
    centers = {k: x[c == k].mean(axis=0) for k in set(c) - {-1}}
    want = []
    for v, k in zip(x, c):
        if k != -1:
            a = np.linalg.norm(v - centers[k])
            b = min(np.linalg.norm(v - m) for j, m in centers.items() if j != k)
            want.append(0.0 if k == 7 else (b - a) / max(a, b))
    assert centroid_silhouette(df).first()[0] == pytest.approx(np.mean(want))
    assert centroid_silhouette(df.where("cluster_id = 7")).first()[0] is None


def test_silhouette_with_copies_and_a_single(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    x[5:20] = x[5]
    c = np.array([0] * 12 + [1] * 27 + [2])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(40):
        own = c == c[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, list(map(float, x[i])), int(c[i])) for i in range(40)], "row_id long, embedding array<double>, cluster_id int")
    assert silhouette(df, block_rows=7).first()[0] == pytest.approx(np.mean(want))


def separable(vectors, classes=2, n=150):
    rng = np.random.default_rng(0)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, 4))
    x[:, 0] += 6 * y
    return vectors(x, label=y)


def test_classifiers_on_separable_data(vectors):
    table = {r["model"]: r for r in supervised.evaluate_classifiers_cv(separable(vectors)).collect()}
    assert set(table) == set(supervised.CLASSIFIERS)
    for r in table.values():
        assert r["accuracy_mean"] > 0.95 and r["roc_auc_mean"] > 0.95 and len(r["f1_scores"]) == 5 and r["error"] is None


def test_forest_keeps_nodes_between_levels_and_grows_the_same_trees(vectors):
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(2)
    data = vectors(rng.normal(size=(200, 3)), label=rng.integers(0, 2, 200)).select(
        array_to_vector("embedding").alias("_vec"), "label", F.lit(1.0).alias("weight"))
    forest = supervised.random_forest(200.0).setNumTrees(5)
    assert forest.getCacheNodeIds()
    trees = lambda f: f.fit(data).toDebugString.split("\n", 1)[1]  # noqa: E731 - the first line has the model's own id
    assert trees(forest) == trees(supervised.random_forest(200.0).setNumTrees(5).setCacheNodeIds(False))


def test_a_failing_classifier_leaves_an_error_row(vectors):
    def broken(weight_sum):
        raise RuntimeError("cannot fit")
    table = supervised.evaluate_classifiers_cv(separable(vectors), {"LogReg": supervised.logistic_regression, "Broken": broken})
    rows = {r["model"]: r for r in table.collect()}
    assert rows["Broken"]["error"] == "cannot fit" and rows["LogReg"]["error"] is None


def test_logistic_regression_agrees_with_newton(spark, vectors):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + rng.normal(size=120) > 0.8).astype(int)
    from pyspark.ml.functions import array_to_vector
    n1 = y.sum()
    w = np.where(y == 1, 120 / (2 * n1), 120 / (2 * (120 - n1)))
    rows = [(list(map(float, x[i])), int(y[i]), float(w[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "v array<double>, label int, weight double").withColumn("_vec", array_to_vector("v"))
    model = supervised.logistic_regression(float(w.sum())).fit(df)
    a = np.c_[x, np.ones(120)]
    beta = np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge, a.T @ (w * (p - y)) + ridge @ beta)
    assert np.allclose(np.r_[model.coefficients.toArray(), model.intercept], beta, atol=1e-3)


@pytest.mark.parametrize("classes", [2, 3])
def test_extra_trees_on_separable_data(vectors, classes):
    df = separable(vectors, classes).withColumnRenamed("embedding", "features")
    r = supervised.evaluate_extratrees_cv(df, multi_class=classes > 2, trees=10).first()
    assert r["accuracy"] > 0.93 and r["roc_auc"] > 0.95 and r["n_classes"] == classes and r["n_features"] == 4
    assert sum(r["class_distribution"]) == 150


def slow_tree(x, y, weight, node, tries, grown):
    """One tree node by node; a leaf holds its class shares."""
    counts = np.bincount(y, minlength=len(weight))
    ident = np.array([node], np.uint64)
    order = [c for c in np.argsort(extra_trees.draw(ident, x.shape[1], 0)[0]) if x[:, c].min() < x[:, c].max()][:tries]
    if (counts > 0).sum() < 2 or not order:
        grown.append(len(x))
        return counts * weight / (counts * weight).sum()
    u = extra_trees.draw(ident, x.shape[1], 1)[0]
    best = None
    for c in order:
        lo, hi = x[:, c].min(), x[:, c].max()
        line = lo + u[c] * (hi - lo)
        left = x[:, c] <= (lo if line >= hi else line)
        cost = 0.0
        for side in (left, ~left):
            w = np.bincount(y[side], minlength=len(weight)) * weight
            cost += w.sum() - (w * w).sum() / w.sum()
        if best is None or cost < best[0] - 1e-9:
            best = (cost, c, lo if line >= hi else line, left)
    _, c, line, left = best
    children = [extra_trees.child_of(ident, side)[0] for side in (0, 1)]
    return c, line, slow_tree(x[left], y[left], weight, children[0], tries, grown), slow_tree(x[~left], y[~left], weight, children[1], tries, grown)


def slow_shares(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("task_rows", [100_000, 60, 7])
def test_extra_trees_are_those_of_one_machine(spark, task_rows):
    rng = np.random.default_rng(31)
    x = np.c_[rng.normal(size=(300, 3)), rng.integers(0, 3, 300), np.ones(300)]
    x[:90] = x[0]  # equal rows with different labels: a leaf that no split can clear, larger than a task
    y, fold = rng.integers(0, 3, 300), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(300)], "row_id long, features array<double>, label int, fold int")
    got = {r.row_id: r for r in extra_trees.out_of_fold(df, 3, 3, trees=4, task_rows=task_rows).collect()}
    assert len(got) == 300
    for f in range(3):
        own = fold != f
        weight = extra_trees.class_weights(np.bincount(y[own], minlength=3).astype(float))
        leaves, forest = [], []
        for t in range(4):
            forest.append(slow_tree(x[own], y[own], weight, extra_trees.root_of(np.array([f * 4 + t]), 42)[0], 2, leaves))
        for i in np.flatnonzero(~own):
            want = np.mean([slow_shares(tree, x[i]) for tree in forest], axis=0)
            assert got[i].scores == pytest.approx(want, abs=1e-9) and got[i].fold == f
    one = extra_trees.out_of_fold(df, 3, 3, trees=4, task_rows=task_rows, only=1).collect()
    assert {r.row_id: r.scores for r in one} == {i: pytest.approx(got[i].scores) for i in np.flatnonzero(fold == 1)}


def test_flow_files_are_fitted_on_their_union(spark):
    rng = np.random.default_rng(2)
    def flows(n, protos):
        return spark.createDataFrame(
            [(i, str(rng.choice(protos)), float(rng.normal() + 4 * (i % 3)), int(i % 3 == 2), ["Normal", "Normal", "DoS"][i % 3]) for i in range(n)],
            "row_id long, proto string, dur double, label int, attack_cat string",
        )
    out = supervised.evaluate_flows(spark, flows(60, ["tcp", "udp"]), flows(30, ["arp", "udp"]))
    r = out.collect()
    assert len(r) == 1 and r[0]["n_samples"] == 90 and r[0]["n_features"] == 2
    assert supervised.evaluate_flows(spark, flows(10, ["tcp"]).drop("label"), flows(10, ["tcp"]).drop("label")) is None


def test_codes_fitted_elsewhere(spark):
    rows = spark.createDataFrame([(0, "b", 1.0, 0), (1, "a", 3.0, 1)], "row_id long, proto string, dur double, label int")
    from tracewarden.operators import encoding
    codes = encoding.category_codes(spark.createDataFrame([("a",), ("aa",), ("b",)], "proto string"), ["proto"], "nan")
    bounds = spark.createDataFrame([(0.0, 2.0, 0.0, 4.0)], "_lo_proto double, _hi_proto double, _lo_dur double, _hi_dur double")
    got = loaders.load_unsw_nb15_cleaned(spark, rows, codes=codes, bounds=bounds).orderBy("row_id").collect()
    assert [r["features"] for r in got] == [[1.0, 0.25], [0.0, 0.75]]


def test_reduction_in_the_result_rows(vectors, monkeypatch):
    monkeypatch.setattr(supervised, "MAX_COMPONENTS", 2)
    r = supervised.evaluate_embeddings_cv(separable(vectors), "m", classifiers={"LogReg": supervised.logistic_regression}).first()
    assert r["methodology"] == "5_fold_cv_plus_pca" and 0 < r["pca_explained_variance"] < 1


def test_score_statistics_on_the_large_path(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(s), int(s > 1)) for s in rng.normal(size=500)], "score double, is_anomaly int")
    want = metrics.score_statistics(df).first().asDict()
    from tracewarden.operators import ranking
    monkeypatch.setattr(metrics, "IN_PLAN_LIMIT", 1)
    monkeypatch.setattr(ranking, "IN_PLAN_LIMIT", 1)
    got = metrics.score_statistics(df).first().asDict()
    assert got == pytest.approx(want)
    assert df.where(F.col("score") > 99).count() == 0


def test_silhouette_distances_hold_for_near_rows_far_from_the_origin():
    from tracewarden.operators.silhouette import _distances
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 8)) + 1000
    b = np.vstack([a[:20] + 1e-7 * rng.normal(size=(20, 8)), rng.normal(size=(30, 8))])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.allclose(_distances(a, b), want, rtol=1e-9, atol=0)


def test_silhouette_blocks_grow_with_the_table():
    from tracewarden.operators import silhouette as measure
    parts = [-(-n // measure.block_size(n, 64, measure.BLOCK_ROWS, measure.MAX_BLOCKS)) for n in (1_000, 100_000, 600_000, 1_500_000)]
    assert parts == [1, 24, 24, 24]


def test_rows_travel_to_trees_packed(spark):
    """One value for each node and chunk of rows, in place of one row for each row and tree; rows may share an id."""
    rng = np.random.default_rng(5)
    x, y, fold = rng.normal(size=(400, 4)), rng.integers(0, 2, 400), np.arange(400) % 2
    df = spark.createDataFrame([(i // 2, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(400)], "row_id long, features array<double>, label int, fold int").coalesce(1)
    data = df.withColumn("number", F.monotonically_increasing_id())
    for task_rows in (1000, 50):
        upper = extra_trees.UpperNodes(np.zeros(6, int), extra_trees.root_of(np.arange(6), 1), np.tile(np.bincount(y[fold == 1], minlength=2).astype(float), (6, 1)))
        extra_trees.grow_upper(data.select("features", "label", "fold"), upper, 4, 2, task_rows)
        sent = extra_trees._dealt(data, upper, 0 if upper.levels else 3).collect()
        assert len(sent) == len({r.group for r in sent})
        rows = sum(len(r.rows) for r in sent) // (7 * 8)
        assert 6 * 300 < rows <= 6 * 400 if upper.levels else rows == 3 * 400
        got = extra_trees.out_of_fold(df, 2, 2, trees=6, task_rows=task_rows).collect()
        assert sorted((r.row_id, r.fold) for r in got) == sorted((i // 2, int(fold[i])) for i in range(400))


def test_nothing_is_grown_below_nodes_without_held_rows(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.random((4000, 3)), rng.integers(0, 2, 4000)
    tried, candidates = [], extra_trees.candidates
    monkeypatch.setattr(extra_trees, "candidates", lambda node, *rest: tried.append(len(node)) or candidates(node, *rest))
    few = extra_trees.finish(x, y, x[:3] + 1e-3, np.uint64(7), np.ones(2), 1)
    assert max(tried) <= 3
    many = extra_trees.finish(x, y, np.concatenate([x[:3] + 1e-3, rng.random((4000, 3))]), np.uint64(7), np.ones(2), 1)
    assert np.array_equal(few, many[:3])
