"""The driver contract on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as contract

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_queries  # noqa: E402

SF = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.oracle_sql()) > 90


def test_entry_gives_one_row(spark):
    df = contract.entry(spark)
    assert df.count() == 1 and "anomaly_ratio" in df.columns


@pytest.mark.parametrize("name", [
    "load_event_traces", "load_flow_features_multi_class", "stratified_split", "local_outlier_factor", "contamination_elbow",
    "combine_votes", "dbscan_fine", "ranking_metrics", "retrieval_prompts", "majority_vote", "operation_summary",
])
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for table in check_queries.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    status, _, _, detail = check_queries.compare(spark, con, name, SF)
    assert status.startswith("ok"), (status, detail)
