"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_QUERIES: comma-separated names instead of the headline ones, or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewarden.plans.catalog import QUERIES  # noqa: E402
from tracewarden.session import build_session  # noqa: E402

HEADLINE = [
    "load_event_traces", "load_flows_as_text", "load_flow_features", "load_hdfs_unlabeled", "enrich_with_templates",
    "drop_duplicate_rows", "stratified_split", "stratified_folds", "hash_rank", "hashing_embedding", "tfidf_terms",
    "nearest_neighbors", "contamination_statistical", "local_outlier_factor", "detect_isolation_forest",
    "detect_one_class_svm", "detect_elliptic_envelope", "combine_votes", "dbscan_plane", "hdbscan_plane",
    "silhouette_score", "binary_metrics", "ranking_metrics", "score_statistics", "similarity_search",
    "retrieval_context", "majority_vote", "operation_summary", "detect_and_summarise", "logistic_regression_cv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name:36s} {seconds[name]:8.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
