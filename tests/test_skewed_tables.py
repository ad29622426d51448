"""Registered queries on tables where one key holds a third of all rows."""

import duckdb
import oracle
import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"
CHANGES = {
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id)",
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS o_custkey)",
    "lineitem": "* REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_orderkey END AS l_orderkey)",
    "documents": "* REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source)",
    "embeddings": "* REPLACE (CASE WHEN vec_id % 3 = 0 THEN 0 ELSE label END AS label)",
}
NAMES = [
    "gold_leakage_fact", "hourly_energy", "curtailment_episodes", "notice_matches", "leakage_running", "latest_reading",
    "upsert_latest_state", "facts_with_finance", "facts_with_commercial", "ranked_evidence", "evidence_packs", "routed_cases",
    "retrieved_chunks", "cached_retrieval", "terminal_statuses", "daily_cost_mart", "run_facts", "replaced_children",
    "upserted_parents", "stream_silver_split",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for table in oracle.TABLES:
        con.execute(f"COPY (SELECT {CHANGES.get(table, '*')} FROM '{SOURCE}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_do_not_change_results(spark, skewed, name):
    got = oracle.spark_rows(entry.queries()[name](spark, skewed))
    assert oracle.difference(got, oracle.sql_rows(oracle.connect(skewed), entry.oracle_sql()[name])) is None
