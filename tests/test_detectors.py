import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import detectors, envelope, isolation_forest, one_class_svm
from tracewarden.operators import vectors as vec
from tracewarden.operators.ranking import column_order_statistics, quantiles
from tracewarden.operators.reduction import summed


def planted(seed=0, n=300, d=5, bad=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:bad] += rng.choice([-7, 7], size=(bad, d))
    return x


@pytest.mark.parametrize("method", list(detectors.SCORERS))
def test_planted_outliers_are_found(vectors, method):
    x = planted()
    flags = {r["row_id"] for r in detectors.detect(vectors(x), method, 0.05).where("is_anomaly = 1").collect()}
    assert len(flags & set(range(12))) >= 10
    assert abs(len(flags) - 15) <= 2


def test_scores_do_not_depend_on_partitions(vectors):
    df = vectors(planted(1))
    one = {r["row_id"]: r["score"] for r in isolation_forest.forest_scores(df, isolation_forest.fit_forest(df.coalesce(1))).collect()}
    two = {r["row_id"]: r["score"] for r in isolation_forest.forest_scores(df, isolation_forest.fit_forest(df.repartition(9))).collect()}
    assert one == two


def test_chi_square_quantiles():
    assert np.isclose(envelope.chi2_quantile(0.5, 2), 2 * np.log(2), atol=1e-9)
    assert np.isclose(envelope.chi2_quantile(0.975, 10), 20.4831774, atol=1e-5)


def test_envelope_reports_the_usual_covariance_scale(vectors):
    x = np.random.default_rng(3).normal(size=(600, 3))
    dist = [-r["score"] for r in envelope.envelope_scores(vectors(x)).collect()]
    assert 1.5 < np.median(dist) < 3.2  # chi-square with 3 degrees: 2.37


def test_envelope_needs_more_rows_than_columns(vectors):
    with pytest.raises(ValueError):
        envelope.envelope_scores(vectors(np.eye(4)))


def test_ensemble_skips_a_failing_detector(vectors):
    x = planted(2, n=60, d=80)  # too few rows for the envelope
    votes, combined = detectors.detect_anomalies(vectors(x), 0.1)
    assert {r["method"] for r in votes.select("method").distinct().collect()} == set(detectors.SCORERS) - {"EllipticEnvelope"}
    assert combined.count() == 60


def test_all_detectors_failing(vectors, monkeypatch):
    def broken(df, contamination, vec_col):
        raise ValueError("no")
    monkeypatch.setattr(detectors, "SCORERS", {"a": broken})
    with pytest.raises(RuntimeError):
        detectors.run_detectors(vectors(np.eye(3)))


@pytest.mark.parametrize("error", [RuntimeError("lost"), ValueError("lost")])
def test_a_failing_detector_does_not_look_like_a_vote(vectors, monkeypatch, error):
    def broken(df, contamination, vec_col):
        raise error
    monkeypatch.setitem(detectors.SCORERS, "LocalOutlierFactor", broken)
    with pytest.raises(RuntimeError, match="LocalOutlierFactor failed: .*lost"):
        detectors.detect_anomalies(vectors(planted(2, n=60)), 0.1)


def test_the_whole_ensemble_wants_every_detector(vectors):
    few = vectors(planted(2, n=60, d=80))  # too few rows for the envelope
    with pytest.raises(envelope.NotApplicable):
        detectors.detect_anomalies(few, 0.1, whole=True)
    votes, _ = detectors.detect_anomalies(vectors(planted(2, n=60)), 0.1, whole=True)
    assert {r["method"] for r in votes.select("method").distinct().collect()} == set(detectors.SCORERS)


def test_unknown_method_and_empty_input(vectors, spark):
    with pytest.raises(ValueError):
        detectors.detect(vectors(np.eye(3)), "nope")
    with pytest.raises(ValueError):
        detectors.detect_anomalies(spark.createDataFrame([], "row_id long, embedding array<double>"))


@pytest.mark.parametrize("votes,want", [("1100", 1), ("1000", 0), ("110", 1), ("100", 0)])
def test_vote_golden(spark, votes, want):
    rows = [(0, m, int(v), 0.0) for m, v in zip("abcd", votes)]
    got = detectors.combine_votes(spark.createDataFrame(rows, "row_id long, method string, is_anomaly int, score double")).first()
    assert got["is_anomaly"] == want


def test_contamination_goldens(vectors):
    flat = np.array([(1, 5), (2, 5), (3, 5), (4, 5), (100, 6)], dtype=float)
    assert vec.contamination_statistical(vectors(flat)).first()[0] == pytest.approx(0.2)
    line = np.array([[0.0], [1.0], [2.0], [3.0], [10.0]])
    assert vec.contamination_elbow(vectors(line), k=2).first()[0] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        vec.estimate_contamination(vectors(line), "guess")


def test_contamination_setting(vectors):
    df = vectors(planted(5))
    assert vec.resolve_contamination(df, "0.9") == 0.5
    assert vec.resolve_contamination(df, 0.0) == 0.001
    assert vec.resolve_contamination(df, "many") == vec.resolve_contamination(df, "auto")


def test_large_path_of_the_statistical_estimate(vectors, monkeypatch):
    df = vectors(planted(6))
    want = vec.contamination_statistical(df).first()[0]
    monkeypatch.setattr(vec, "IN_PLAN_LIMIT", 10)
    assert vec.contamination_statistical(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_order_statistics_with_a_hot_value(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.lognormal(sigma=4, size=999), rng.integers(0, 3, 999)])
    x[:400, 0] = 1.5
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>").repartition(7)
    want = np.sort(x, axis=0)[[0, 1, 499, 998]].T
    assert (column_order_statistics(df, "v", 2, [0, 1, 499, 998], max_cells=64) == want).all()


def test_quantiles_agree_with_numpy_on_both_paths(spark, monkeypatch):
    from tracewarden.operators import ranking
    x = np.random.default_rng(9).normal(size=777)
    df = spark.createDataFrame([(float(v),) for v in x], "s double")
    want = np.percentile(x, [5, 50, 97.5])
    assert np.allclose(quantiles(df, "s", [0.05, 0.5, 0.975]), want)
    monkeypatch.setattr(ranking, "IN_PLAN_LIMIT", 10)
    assert np.allclose(quantiles(df, "s", [0.05, 0.5, 0.975]), want)


def test_pca_matches_numpy(vectors):
    x = np.random.default_rng(10).normal(size=(200, 8)) @ np.diag([5, 4, 3, 2, 1, 1, 1, 1]) + 10
    df = vectors(x)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    for k in (2, 6):
        reduced, model = vec.reduce_dimensionality(df, k)
        got = np.array([r["embedding"] for r in reduced.orderBy("row_id").collect()])
        want = centred @ vt[:k].T
        want *= np.sign((got * want).sum(axis=0))
        assert np.allclose(got, want, atol=1e-8)
        assert np.allclose(model.explained_ratio, (s**2 / (s**2).sum())[:k])
        pick = np.abs(model.components).argmax(axis=1)
        assert (model.components[np.arange(k), pick] > 0).all()
    assert vec.reduce_dimensionality(df, 8)[1] is None
    with pytest.raises(ValueError):
        vec.reduce_dimensionality(df, 3, method="tsne")


def test_train_fit_is_capped(vectors):
    x = np.random.default_rng(11).normal(size=(12, 10))
    df = vectors(x).withColumn("split", F.when(F.col("row_id") < 5, "train").otherwise("test"))
    reduced, model = vec.fit_train_apply_all(df, target_dim=9)
    assert len(model.components) == 4
    assert np.allclose(model.mean, x[:5].mean(axis=0))
    assert reduced.count() == 12


@pytest.mark.parametrize("rows,parts,copies", [(500, 1, 0), (500, 3, 400), (20_000, 6, 0), (20_000, 5, 7000)])
def test_one_class_over_the_table_is_the_solver_on_all_rows(vectors, rows, parts, copies):
    x = np.random.default_rng(21).normal(size=(rows, 6))
    x[:copies] = x[0]
    weights, phase = one_class_svm.feature_map(0.1, 6, features=32)
    df = vectors(x).select("embedding").repartition(parts).cache()
    got = one_class_svm.solve_table(df, 0.07, weights, phase, rows, 8)
    want = one_class_svm.solve(one_class_svm.mapped(x, weights, phase), 0.07, 8)
    assert np.abs(got - want).max() < 1e-9


def test_one_class_cut_among_equal_scores(vectors):
    x = np.concatenate([np.zeros((5000, 3)), np.ones((10, 3))])
    weights, phase = one_class_svm.feature_map(0.5, 3, features=16)
    got = one_class_svm.solve_table(vectors(x).select("embedding").repartition(4), 0.3, weights, phase, len(x), 4)
    assert np.abs(got - one_class_svm.solve(one_class_svm.mapped(x, weights, phase), 0.3, 4)).max() < 1e-9


def test_sums_in_levels(spark):
    parts = spark.range(0, 200, 1, 40).selectExpr("array(double(id), 1D) AS sums")
    assert summed(parts, 4).tolist() == [199 * 100, 200] and summed(parts.limit(0)) is None
