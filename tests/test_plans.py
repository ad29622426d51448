"""What reaches the scans and how aggregates run, on stored tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridledger.operators import energy, silver
from gridledger.plans import tables
from gridledger.sources import merge

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    tables.bronze(spark, SF_DIR).write.parquet(path + "/bronze")
    rows = tables.silver_rows(spark, SF_DIR).withColumn("event_date", F.to_date("event_ts_utc"))
    rows.write.partitionBy("event_date").parquet(path + "/silver")
    return path


def test_look_back_reaches_the_scan(spark, stored):
    rows = silver.incremental(spark.read.parquet(stored + "/bronze"), "bronze_ingested_at", dt.datetime(2024, 1, 30))
    assert "GreaterThanOrEqual(bronze_ingested_at,2024-01-27" in plan(rows.select("event_id"))


def test_hourly_energy_reads_six_columns_and_hashes(spark, stored):
    text = plan(energy.hourly_energy(spark.read.parquet(stored + "/silver")))
    columns = text.split("FileScan parquet [")[1].split("]")[0]
    assert sorted(c.split("#")[0] for c in columns.split(",") if not c.startswith("event_date")) == [
        "asset_id", "expected_available_kw", "grid_limit_kw", "measured_generation_kw", "operating_status", "reconciliation_hour_utc"]
    assert "HashAggregate" in text and "SortAggregate" not in text and text.count("Exchange") == 1


def test_touched_dates_prune_folders(spark, stored):
    rows = spark.read.parquet(stored + "/silver")
    updates = rows.filter("event_date = '2024-01-05'")
    days = merge.partition_values(updates, "event_date")
    assert days == [dt.date(2024, 1, 5)]
    assert "PartitionFilters: [isnotnull(event_date" in plan(rows.filter(F.col("event_date").isin(days))) or \
        "PartitionFilters: [event_date" in plan(rows.filter(F.col("event_date").isin(days)))


def test_top_k_is_limited_before_the_shuffle(spark):
    from gridledger.operators.cases import top_evidence

    rows = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("breach_event_id"), F.col("id").cast("int").alias("context_rank"),
        F.lit(1).alias("evidence_score"), F.lit("d").alias("document_id"), F.lit(0).alias("chunk_index"))
    text = plan(top_evidence(rows))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_text_work_needs_no_shuffle_and_no_python(spark):
    from gridledger.operators import documents

    docs = spark.createDataFrame([("d", "text")], "document_id string, raw_text_content string")
    text = plan(documents.build_chunks(documents.to_lines(docs), ["document_id"]))
    assert "Exchange" not in text and "Python" not in text.replace("PythonRDD", "")


def test_latest_rows_are_hashed_and_not_sorted(spark, stored):
    rows = spark.read.parquet(stored + "/silver").select("asset_id", "reconciliation_hour_utc", "event_ts_utc", "kafka_offset", "operating_status")
    for picked in (silver.latest_of_many(rows, ["asset_id"], ["event_ts_utc", "kafka_offset"]),
                   silver.first_of_many(rows, ["asset_id", "reconciliation_hour_utc"], ["kafka_offset"])):
        text = plan(picked)
        # What is aggregated has passed the semi-join with the written best values.
        assert "BroadcastHashJoin" in text.split("SortAggregate")[-1] and "LeftSemi" in text


def test_episode_runs_are_planned_once(spark, stored):
    rows = spark.read.parquet(stored + "/silver")
    text = plan(energy.curtailment_episodes(rows, 3600))
    assert "expected_available_kw" not in text and text.count("Window") <= 2


def test_ranges_of_a_quantile_are_read_again_and_not_sorted(spark):
    import random

    import numpy as np

    from gridledger.operators import control_tower, quantiles

    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), r.choice([r.randrange(10 ** 6), r.randrange(100), 500])) for _ in range(4000)] + [("one", 7)] * 3
    table = spark.createDataFrame(rows, "g string, v long")
    counted = table.groupBy("g", "v").agg(F.count("*").alias("n")).cache()
    for q in (0.0, 0.5, 0.95, 0.999, 1.0):
        got = {x.g: x for x in quantiles.exact_quantile(counted, ["g"], "v", "n", q, ranges=8, ordered=5).collect()}
        for g in ("a", "b", None, "one"):
            values = [v for h, v in rows if h == g]
            assert got[g].samples == len(values) and abs(got[g].quantile - np.quantile(values, q)) < 1e-6
            assert abs(got[g].average - np.mean(values)) < 1e-6
    whole = control_tower.latency_stats(table, "v").first()
    assert abs(whole.p95_latency_ms - np.quantile([v for _, v in rows], 0.95)) < 1e-6
    assert control_tower.latency_stats(table.limit(0), "v").first().samples is None
    assert control_tower.latency_stats(table.limit(0), "v", "g").count() == 0
