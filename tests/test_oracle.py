"""Every registered query against its SQL, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from gridledger.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    got = oracle.spark_rows(catalog.QUERIES[name](spark, SF_DIR))
    assert oracle.difference(got, oracle.sql_rows(con, catalog.ORACLES[name])) is None


def test_queries_without_sql_return_rows(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, SF_DIR).count() > 0, name


def test_entry_lists_all_queries():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_entry_works_without_the_text_operators():
    """The subpackage and the pipeline may be taken out."""
    code = (
        "import sys\n"
        "sys.modules['corpus_pipeline'] = sys.modules['gridledger.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'gold_leakage_fact' in e.queries() and e.oracle_sql()\n")
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_plan_needs_a_cross_join(spark):
    """Also with broadcasts off, as when no side is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, build in catalog.QUERIES.items():
            if name.startswith("stream_"):
                continue
            plan = build(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
