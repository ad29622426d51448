"""The registered queries against their SQL, and the pipeline against its stages one by one."""

from collections import Counter

import oracle
import pytest
from test_operators import plain_components

import corpus_pipeline
from gridledger.llm import language, mixing
from gridledger.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    got = oracle.spark_rows(QUERIES[name](spark, SF_DIR))
    assert oracle.difference(got, oracle.sql_rows(oracle.connect(SF_DIR), ORACLES[name])) is None


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(90001, "12 34 ..", None, "src0", 8), (90002, "漢字 " * 300, None, "src0", 900)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    given = [tuple(r) for r in docs.collect()]
    known = corpus_pipeline.language_id(spark, docs, SF_DIR)
    assert known.columns == columns
    assert Counter(map(tuple, known.collect())) == Counter(r for r in given if r[0] < 90000)
    known = known.unionByName(known.filter("doc_id < 5"))
    exact = corpus_pipeline.exact_dedup(spark, known, SF_DIR)
    first = {}
    for r in sorted(r for r in given if r[0] < 90000):
        first.setdefault(" ".join(r[1].split(" ")).replace("\n", " ").replace("  ", " "), r)
    rows = [tuple(r) for r in exact.collect()]
    assert len({r[1] for r in rows}) == len(rows) and {r[0] for r in rows} <= {r[0] for r in first.values()}
    near = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, docs.schema), SF_DIR).collect()]
    assert Counter(r[0] for r in near) == Counter(i for i, (_, c) in plain_components([r[:2] for r in rows]).items() if c == i)
    kept = spark.createDataFrame(near, docs.schema)
    mix = corpus_pipeline.source_mixing(spark, kept, SF_DIR)
    assert mix.columns == columns
    taken = {r.doc_id: r for r in mixing.mixed(kept).collect()}
    times = Counter(r.doc_id for r in mix.collect())
    assert all(abs(times[i] * t.size - t.taken) <= t.size / 2 for i, t in taken.items())


def test_run_gives_ids_of_kept_documents(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    rows = out.collect()
    assert rows and all(len(r.ids) == r.n_tokens for r in rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_language_model_is_found_once(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL")
    assert got.filter("held_out AND lang_pred <> lang").count() == 0
