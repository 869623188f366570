"""Queries: neighbours, contamination, detectors and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.operators import clustering, dbscan, detectors, hdbscan, lof, metrics, one_class_svm
from tracewarden.operators import vectors as vec
from tracewarden.operators.neighbors import knn_join
from tracewarden.operators.silhouette import silhouette
from tracewarden.plans.catalog_rows import fixed
from tracewarden.plans.inputs import FLOWS_SQL, PLANE_SQL, VECTORS_SQL, flows, plane, vectors
from tracewarden.plans.registry import query, table
from tracewarden.plans.workflows import unsupervised_result
from tracewarden.session import materialize, side_by_side
from tracewarden.sources.loaders import load_unsw_nb15_unlabeled

EDGES_SQL = """pairs AS (SELECT a.row_id AS query_id, b.row_id AS neighbor_id, list_distance(a.embedding, b.embedding) AS distance
  FROM vectors a, vectors b WHERE a.row_id <> b.row_id),
edges AS (SELECT query_id, neighbor_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)"""


@query(f"WITH {VECTORS_SQL}, {EDGES_SQL} SELECT query_id, neighbor_id, rank, round(distance, 9) AS distance FROM edges WHERE rank <= 5")
def nearest_neighbors(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return knn_join(rows, rows, 5).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {VECTORS_SQL}, pairs AS (SELECT a.row_id AS query_id, b.row_id AS neighbor_id, 1 - list_cosine_similarity(a.embedding, b.embedding) AS distance
  FROM vectors a, vectors b WHERE a.row_id <> b.row_id)
SELECT query_id, neighbor_id, rank, round(distance, 9) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs) WHERE rank <= 3""")
def nearest_neighbors_cosine(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return knn_join(rows, rows, 3, metric="cosine").withColumn("distance", F.round("distance", 9))


@query(f"WITH {VECTORS_SQL}, {EDGES_SQL} SELECT query_id, neighbor_id, rank, round(distance, 9) AS distance FROM edges WHERE rank <= 5")
def nearest_neighbors_blocked(spark, sf_dir):
    """The pruned multi-block path, forced by a small block."""
    rows = vectors(spark, sf_dir)
    return knn_join(rows, rows, 5, block_rows=200, few_queries=0).withColumn("distance", F.round("distance", 9))


CELLS_SQL = "cells AS (SELECT row_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM vectors)"


@query(f"""WITH {VECTORS_SQL}, {CELLS_SQL}, med AS (SELECT j, median(x) AS m FROM cells GROUP BY j),
dev AS (SELECT row_id, j, abs(x - m) AS d FROM cells JOIN med USING (j)), mad AS (SELECT j, median(d) AS s FROM dev GROUP BY j),
hit AS (SELECT row_id, bool_or(CASE WHEN s = 0 THEN d > 0 ELSE 0.6745 * d / s > 3.5 END) AS o FROM dev JOIN mad USING (j) GROUP BY row_id)
SELECT round(greatest(0.001, least(0.5, avg(CAST(o AS INTEGER)))), 9) AS contamination FROM hit""")
def contamination_statistical(spark, sf_dir):
    found = vec.contamination_statistical(vectors(spark, sf_dir))
    return found.select(F.round(vec.clamp_rate(F.col("contamination")), 9).alias("contamination"))


@query("""WITH cells AS (SELECT row_id, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, [l_quantity, l_extendedprice, l_tax] AS e FROM lineitem)),
med AS (SELECT j, median(x) AS m FROM cells GROUP BY j), dev AS (SELECT row_id, j, abs(x - m) AS d FROM cells JOIN med USING (j)),
mad AS (SELECT j, median(d) AS s FROM dev GROUP BY j),
hit AS (SELECT row_id, bool_or(CASE WHEN s = 0 THEN d > 0 ELSE 0.6745 * d / s > 1.3 END) AS o FROM dev JOIN mad USING (j) GROUP BY row_id)
SELECT j, round(m, 9) AS median, round(s, 9) AS mad FROM med JOIN mad USING (j)""")
def column_medians(spark, sf_dir):
    """Median and absolute deviation per column by histogram narrowing, the path for large tables."""
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_tax").alias("v"))
    n = rows.count()
    spots = [(n - 1) // 2, n // 2]
    med = vec.column_order_statistics(rows, "v", 3, spots).mean(axis=1)
    dev = rows.select(F.zip_with("v", F.array(*[F.lit(float(m)) for m in med]), lambda x, m: F.abs(x - m)).alias("v"))
    mad = vec.column_order_statistics(dev, "v", 3, spots).mean(axis=1)
    out = spark.createDataFrame([(j + 1, float(m), float(s)) for j, (m, s) in enumerate(zip(med, mad))], "j long, median double, mad double")
    return out.select("j", *fixed(["median", "mad"]))


@query(f"""WITH {VECTORS_SQL}, {EDGES_SQL}, kth AS (SELECT distance AS d, row_number() OVER (ORDER BY distance) - 1 AS i, count(*) OVER () AS n FROM edges WHERE rank = 10),
jump AS (SELECT i, n, lead(d) OVER (ORDER BY d, i) - d AS g FROM kth)
SELECT round(greatest(0.001, least(0.5, 1.0 - i / n)), 9) AS contamination FROM jump WHERE g IS NOT NULL ORDER BY g DESC, i LIMIT 1""")
def contamination_elbow(spark, sf_dir):
    found = vec.contamination_elbow(vectors(spark, sf_dir))
    return found.select(F.round(vec.clamp_rate(F.col("contamination")), 9).alias("contamination"))


def lof_sql(k: int) -> str:
    return f"""near AS (SELECT * FROM edges WHERE rank <= {k}), radius AS (SELECT query_id AS id, max(distance) AS kd FROM near GROUP BY 1),
lrd AS (SELECT query_id AS id, 1.0 / (avg(greatest(distance, kd)) + 1e-10) AS lrd FROM near JOIN radius ON id = neighbor_id GROUP BY 1),
lof AS (SELECT query_id AS row_id, avg(b.lrd) / max(a.lrd) AS lof FROM near JOIN lrd a ON a.id = query_id JOIN lrd b ON b.id = neighbor_id GROUP BY 1)"""


@query(f"WITH {VECTORS_SQL}, {EDGES_SQL}, {lof_sql(10)} SELECT round(greatest(0.001, least(0.5, avg(CAST(lof > 1.5 AS INTEGER)))), 9) AS contamination FROM lof")
def contamination_density(spark, sf_dir):
    found = vec.contamination_density(vectors(spark, sf_dir))
    return found.select(F.round(vec.clamp_rate(F.col("contamination")), 9).alias("contamination"))


@query(f"WITH {VECTORS_SQL}, {EDGES_SQL}, {lof_sql(20)} SELECT row_id, round(lof, 9) AS lof FROM lof")
def local_outlier_factor(spark, sf_dir):
    return lof.local_outlier_factor(vectors(spark, sf_dir), 20).withColumn("lof", F.round("lof", 9))


@query(f"""WITH {VECTORS_SQL}, {EDGES_SQL}, {lof_sql(20)}
SELECT row_id, 'LocalOutlierFactor' AS method, CAST(-lof < (SELECT quantile_cont(-lof, 0.1) FROM lof) AS INTEGER) AS is_anomaly, round(-lof, 9) AS score FROM lof""")
def detect_local_outliers(spark, sf_dir):
    return detectors.detect(vectors(spark, sf_dir), "LocalOutlierFactor", 0.1).withColumn("score", F.round("score", 9))


@query()
def detect_isolation_forest(spark, sf_dir):
    return detectors.detect(vectors(spark, sf_dir), "IsolationForest", 0.1)


@query()
def isolation_forest_on_flows(spark, sf_dir):
    """More rows than all tree samples together: every sampled row goes to one tree."""
    rows = materialize(load_unsw_nb15_unlabeled(spark, flows(spark, sf_dir)).select("row_id", F.col("features").alias("embedding")))
    return detectors.detect(rows, "IsolationForest", 0.05)


@query()
def detect_one_class_svm(spark, sf_dir):
    return detectors.detect(vectors(spark, sf_dir), "OneClassSVM", 0.1)


def _one_class_sql(features: int, rounds: int, nu: float) -> str:
    """Rounds of the one-class solver on two columns, with the draws of its feature map as literals."""
    normals, phase = one_class_svm.feature_map(0.5, 2, features=features)
    waves = ", ".join(f"sqrt(2.0 / {features}) * cos(sqrt(2 * gamma) * ({float(normals[0, j])!r} * x + {float(normals[1, j])!r} * y) + {float(phase[j])!r})" for j in range(features))
    each = lambda text: "[" + ", ".join(text.format(j=j) for j in range(1, features + 1)) + "]"
    parts = [f"""pairs AS (SELECT row_id, sbytes / 100000.0 AS x, rate * 10.0 AS y FROM flows),
width AS (SELECT 1.0 / (2 * (sum(x * x + y * y) / (2 * count(*)) - pow(sum(x + y) / (2 * count(*)), 2))) AS gamma, greatest({nu} * count(*), 1.0) AS cap, count(*) AS n FROM pairs),
z AS MATERIALIZED (SELECT row_id, [{waves}] AS z FROM pairs, width),
w0 AS MATERIALIZED (SELECT {each('avg(z[{j}])')} AS w FROM z)"""]
    for t in range(rounds):
        parts.append(f"""s{t} AS MATERIALIZED (SELECT z, list_dot_product(z, w) AS s FROM z, w{t}),
cut{t} AS (SELECT min(s) AS cut FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM s{t}), width WHERE i >= least(floor(cap), n - 1)),
corner{t} AS (SELECT {each('(coalesce(sum(z[{j}]) FILTER (WHERE s < cut), 0) + (max(cap) - count(*) FILTER (WHERE s < cut)) / count(*) FILTER (WHERE s = cut) * sum(z[{j}]) FILTER (WHERE s = cut)) / max(cap)')} AS c
  FROM s{t}, cut{t}, width),
w{t + 1} AS MATERIALIZED (SELECT list_transform(range(1, {features + 1}), lambda j: w[j] + least(1.0, greatest(0.0, -list_dot_product(w, d) / list_dot_product(d, d))) * d[j]) AS w
  FROM (SELECT w, {each('c[{j}] - w[{j}]')} AS d FROM w{t}, corner{t}))""")
    return f"WITH {FLOWS_SQL}, " + ", ".join(parts) + f" SELECT row_id, round(list_dot_product(z, w), 6) AS score FROM z, w{rounds}"


@query(_one_class_sql(8, 3, 0.05))
def one_class_two_columns(spark, sf_dir):
    """Three rounds of the one-class solver over all flows, on two of their columns and a small feature map."""
    rows = flows(spark, sf_dir).select("row_id", F.array(F.col("sbytes") / 100000.0, F.col("rate") * 10.0).alias("embedding"))
    return one_class_svm.one_class_scores(rows, 0.05, features=8, rounds=3).withColumn("score", F.round("score", 6))


@query()
def detect_elliptic_envelope(spark, sf_dir):
    return detectors.detect(vectors(spark, sf_dir), "EllipticEnvelope", 0.1)


@query()
def detect_ensemble(spark, sf_dir):
    """The vote of all four detectors; one that fails or cannot judge the rows is an error, since the vote would not show it."""
    votes, combined = detectors.detect_anomalies(vectors(spark, sf_dir), 0.1, whole=True)
    return combined


VOTES_SQL = """votes AS (
  SELECT event_id AS row_id, 'a' AS method, CAST(value > 150 AS INTEGER) AS is_anomaly, -value AS score FROM events
  UNION ALL SELECT event_id, 'b', CAST(abs(value - 50) > 60 AS INTEGER), -abs(value - 50) FROM events
  UNION ALL SELECT event_id, 'c', CAST(event_type = 'error' AS INTEGER), CASE WHEN event_type = 'error' THEN -1.0 ELSE 1.0 END FROM events
  UNION ALL SELECT event_id, 'd', CAST(user_id > 120 AS INTEGER), CAST(-user_id AS DOUBLE) FROM events)"""


def votes(spark, sf_dir):
    ev, v = table(spark, sf_dir, "events"), F.col("value")
    err = F.col("event_type") == "error"
    one = lambda name, flag, score: F.struct(F.lit(name).alias("method"), flag.cast("int").alias("is_anomaly"), score.cast("double").alias("score"))
    rows = F.explode(F.array(
        one("a", v > 150, -v), one("b", F.abs(v - 50) > 60, -F.abs(v - 50)), one("c", err, F.when(err, -1.0).otherwise(1.0)),
        one("d", F.col("user_id") > 120, -F.col("user_id")),
    ))
    return ev.select(F.col("event_id").alias("row_id"), rows.alias("r")).select("row_id", "r.*")


@query(f"""WITH {VOTES_SQL}, s AS (SELECT *, (score - min(score) OVER (PARTITION BY method)) / (max(score) OVER (PARTITION BY method) - min(score) OVER (PARTITION BY method) + 1e-8) AS z FROM votes)
SELECT row_id, CAST(avg(is_anomaly) >= 0.5 AS INTEGER) AS is_anomaly, round(avg(z), 9) AS score FROM s GROUP BY row_id""")
def combine_votes(spark, sf_dir):
    return detectors.combine_votes(votes(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"WITH {VOTES_SQL} SELECT method, CAST(sum(is_anomaly) AS BIGINT) AS anomalies_detected, round(avg(is_anomaly), 9) AS anomaly_ratio FROM votes GROUP BY method")
def method_info(spark, sf_dir):
    return detectors.method_info(votes(spark, sf_dir)).withColumn("anomaly_ratio", F.round("anomaly_ratio", 9))


# ------------------------------------------------------------------ components and clustering


@query()
def principal_components(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    reduced, _ = vec.reduce_dimensionality(rows, 16)
    return reduced.select("row_id", *[F.round(F.get("embedding", i), 9).alias(f"pc{i + 1}") for i in range(16)])


@query()
def projection_table(spark, sf_dir):
    from tracewarden.operators.sampling import stratified_split
    rows = materialize(stratified_split(vectors(spark, sf_dir)))
    flat, _ = vec.projection_table(rows)
    return flat


@query(f"""WITH {VECTORS_SQL} SELECT split, label, n, upper(split[1]) || split[2:] || CASE label WHEN 0 THEN ' Normal' ELSE ' Anomaly' END || ' (n=' || n || ')' AS series
FROM (SELECT CASE WHEN class < 5 THEN 'train' ELSE 'test' END AS split, label, count(*) AS n FROM vectors GROUP BY 1, 2)""")
def series_counts(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("split", F.when(F.col("class") < 5, "train").otherwise("test"))
    return vec.series_counts(rows)


NEAR_SQL = "near AS (SELECT a.row_id AS a, b.row_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM points a, points b)"
DBSCAN_SQL = f"""WITH RECURSIVE {PLANE_SQL}, {NEAR_SQL},
kth AS (SELECT d FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM near) WHERE r = 5),
par AS (SELECT {{eps}} AS eps, {{needed}} AS needed),
core AS (SELECT a AS id FROM near, par WHERE d <= eps GROUP BY a, needed HAVING count(*) >= needed),
links AS (SELECT a, b FROM near, par WHERE d <= eps AND a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT b AS id, min(a) AS root FROM reach GROUP BY b),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS c FROM roots),
border AS (SELECT a AS id, min(c) AS c FROM near JOIN numbered ON numbered.id = near.b, par WHERE d <= eps AND a NOT IN (FROM core) GROUP BY a)
SELECT row_id, CAST(coalesce(n.c, b.c, -1) AS INTEGER) AS cluster_id FROM points LEFT JOIN numbered n ON n.id = row_id LEFT JOIN border b ON b.id = row_id"""


@query(DBSCAN_SQL.format(eps="(SELECT quantile_cont(d, 0.95) FROM kth)", needed="(SELECT greatest(3, CAST(floor(count(*) * 0.005) AS INTEGER)) FROM points)"))
def dbscan_plane(spark, sf_dir):
    points = materialize(clustering.plane(plane(spark, sf_dir)))
    labels, _ = clustering.run_dbscan(points)
    return labels.select("row_id", "cluster_id")


@query(DBSCAN_SQL.format(eps="0.012", needed="4"))
def dbscan_fine(spark, sf_dir):
    """A small radius, hence many clusters, border rows and noise; on the grid, the path for large tables."""
    return dbscan.dbscan(materialize(clustering.plane(plane(spark, sf_dir))), 0.012, 4, local_points=0)


@query()
def hdbscan_plane(spark, sf_dir):
    labels, _ = clustering.run_hdbscan(materialize(clustering.plane(plane(spark, sf_dir))))
    return labels.select("row_id", "cluster_id", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {PLANE_SQL}, {NEAR_SQL}, par AS (SELECT greatest(5, CAST(floor(count(*) * 0.01) AS INTEGER)) AS m FROM points),
grown AS (
  SELECT row_id AS root, [row_id] AS members, CAST(0 AS DOUBLE) AS w FROM points
  UNION ALL
  SELECT root, members || [b], greatest(w, d) FROM (
    SELECT e.root, e.members, e.w, near.b, near.d, row_number() OVER (PARTITION BY e.root ORDER BY near.d, near.b) AS k
    FROM (SELECT root, members, w, unnest(members) AS a FROM grown, par WHERE len(members) < m) e JOIN near ON near.a = e.a WHERE NOT list_contains(e.members, near.b))
  WHERE k = 1)
SELECT root AS row_id, round(w, 9) AS exit_distance FROM grown, par WHERE len(members) = m""")
def hdbscan_exits(spark, sf_dir):
    """Where each point's group first reaches the least cluster size, by blocks, Boruvka rounds and halved parts."""
    points = materialize(clustering.plane(plane(spark, sf_dir)).select(F.col("row_id").alias("id"), "x", "y", F.lit(1).alias("w")))
    n = points.count()
    spanning = hdbscan.boruvka(hdbscan.candidate_edges(points.select("id", "x", "y"), n, block_points=128))
    exits, _ = hdbscan.exits_of_tree(points.select("id", "w"), spanning, max(5, int(n * 0.01)), local_edges=300)
    return exits.select(F.col("point").alias("row_id"), F.round("w", 9).alias("exit_distance"))


@query()
def hdbscan_components(spark, sf_dir):
    """Clusters on the two leading components of the whole vectors, by the path for large tables."""
    points = materialize(clustering.plane(vectors(spark, sf_dir)))
    found = hdbscan.hdbscan(points, max(5, int(points.count() * 0.01)), local_points=0, block_points=512, local_edges=500)
    return found.select("row_id", "cluster_id", F.round("outlier_score", 9).alias("score"))


@query()
def dbscan_components(spark, sf_dir):
    """The same for DBSCAN, on the grid."""
    points = materialize(clustering.plane(vectors(spark, sf_dir)))
    return dbscan.dbscan(points, dbscan.estimate_eps(points), max(3, int(points.count() * 0.005)), local_points=0)


CLUSTERED_SQL = """clustered AS (SELECT row_id, embedding, CASE WHEN class = 0 THEN -1 ELSE class END AS cluster_id,
  CASE WHEN class = 0 THEN 1 ELSE 0 END AS is_anomaly FROM vectors)"""


def clustered(spark, sf_dir):
    """The class as cluster, class 0 as noise."""
    return vectors(spark, sf_dir).select(
        "row_id", "embedding", F.when(F.col("class") == 0, -1).otherwise(F.col("class")).alias("cluster_id"),
        (F.col("class") == 0).cast("int").alias("is_anomaly"),
    )


@query(f"""WITH {VECTORS_SQL}, {CLUSTERED_SQL} SELECT 'dbscan' AS method, count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) AS n_clusters,
CAST(sum(is_anomaly) AS BIGINT) AS anomalies_detected, round(avg(is_anomaly), 9) AS anomaly_ratio FROM clustered""")
def cluster_statistics(spark, sf_dir):
    rows = clustered(spark, sf_dir).withColumn("method", F.lit("dbscan"))
    return clustering.cluster_statistics(rows).withColumn("anomaly_ratio", F.round("anomaly_ratio", 9))


@query(f"""WITH {VECTORS_SQL}, {CLUSTERED_SQL} SELECT row_id, CASE WHEN cluster_id >= 0 THEN cluster_id + 100 ELSE cluster_id END AS cluster_id FROM clustered""")
def preferred_cluster_labels(spark, sf_dir):
    grid = clustered(spark, sf_dir).select("row_id", "cluster_id").withColumn("method", F.lit("dbscan"))
    tree = grid.select("row_id", F.when(F.col("cluster_id") >= 0, F.col("cluster_id") + 100).otherwise(-1).alias("cluster_id"), F.lit("hdbscan").alias("method"))
    return clustering.preferred_labels(grid.unionByName(tree))


@query(f"""WITH {VECTORS_SQL}, {CLUSTERED_SQL}, c AS (SELECT * FROM clustered WHERE cluster_id <> -1), size AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1),
d AS (SELECT a.row_id, a.cluster_id AS own, b.cluster_id AS other, sum(list_distance(a.embedding, b.embedding)) AS s FROM c a, c b GROUP BY 1, 2, 3),
m AS (SELECT row_id, own, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b
  FROM d JOIN size ON size.cluster_id = other GROUP BY 1, 2)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette_score FROM m""")
def silhouette_score(spark, sf_dir):
    return silhouette(clustered(spark, sf_dir)).select(F.round("silhouette_score", 9).alias("silhouette_score"))


@query(f"""WITH {VECTORS_SQL}, {CLUSTERED_SQL}, x AS (SELECT row_id, cluster_id AS c, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM clustered WHERE cluster_id <> -1),
cen AS (SELECT c, j, avg(v) AS m FROM x GROUP BY 1, 2),
spread AS (SELECT c, avg(d) AS s FROM (SELECT row_id, c, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN cen USING (c, j) GROUP BY 1, 2) GROUP BY 1),
gap AS (SELECT a.c AS a, b.c AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g FROM cen a JOIN cen b ON a.j = b.j AND a.c <> b.c GROUP BY 1, 2)
SELECT round(avg(w), 9) AS davies_bouldin_score FROM (SELECT a, max((p.s + q.s) / g) AS w FROM gap JOIN spread p ON p.c = a JOIN spread q ON q.c = b GROUP BY a)""")
def davies_bouldin_score(spark, sf_dir):
    return metrics.davies_bouldin(clustered(spark, sf_dir)).select(F.round("davies_bouldin_score", 9).alias("davies_bouldin_score"))


# ------------------------------------------------------------------ the flagship


@query()
def detect_unlabelled_vectors(spark, sf_dir):
    """Contamination, four detectors and their vote, two clusterings, quality figures: one row."""
    result, _, _, _ = unsupervised_result(vectors(spark, sf_dir).select("row_id", "embedding"), "vectors", "hdfs")
    return result


@query(f"""WITH {VECTORS_SQL}, {EDGES_SQL}, {lof_sql(20)}, {CELLS_SQL}, med AS (SELECT j, median(x) AS m FROM cells GROUP BY j),
dev AS (SELECT row_id, j, abs(x - m) AS d FROM cells JOIN med USING (j)), mad AS (SELECT j, median(d) AS s FROM dev GROUP BY j),
hit AS (SELECT row_id, bool_or(CASE WHEN s = 0 THEN d > 0 ELSE 0.6745 * d / s > 3.5 END) AS o FROM dev JOIN mad USING (j) GROUP BY row_id),
rate AS (SELECT greatest(0.001, least(0.5, avg(CAST(o AS INTEGER)))) AS c FROM hit),
pos AS (SELECT c, c * (SELECT count(*) - 1 FROM lof) AS p FROM rate),
ranked AS (SELECT -lof AS score, row_number() OVER (ORDER BY -lof) - 1 AS i FROM lof),
cut AS (SELECT max(c) AS c, max(CASE WHEN i = floor(p) THEN score END) + (max(p) - floor(max(p))) * (max(CASE WHEN i = floor(p) + 1 THEN score END) - max(CASE WHEN i = floor(p) THEN score END)) AS o FROM ranked, pos),
flagged AS (SELECT -lof AS score, CAST(-lof < o AS INTEGER) AS f, c FROM lof, cut)
SELECT round(max(c), 9) AS contamination, count(*) AS num_samples, CAST(sum(f) AS BIGINT) AS num_anomalies, round(avg(f), 9) AS anomaly_ratio, round(avg(score), 9) AS score_mean,
round(stddev_pop(score), 9) AS score_std, round(median(score), 9) AS score_median,
round(avg(score) FILTER (WHERE f = 1) - avg(score) FILTER (WHERE f = 0), 9) AS score_separation FROM flagged""")
def detect_and_summarise(spark, sf_dir):
    """Estimated contamination, local outlier factor, cut, counts and score statistics: one row."""
    rows = vectors(spark, sf_dir)
    rate = vec.estimate_contamination(rows)
    flagged = materialize(detectors.detect(rows, "LocalOutlierFactor", rate))
    row = side_by_side(metrics.detection_counts(flagged), metrics.score_statistics(flagged))
    names = ["contamination", "anomaly_ratio", "score_mean", "score_std", "score_median", "score_separation"]
    return row.withColumn("contamination", F.lit(rate)).select("num_samples", "num_anomalies", *fixed(names))
