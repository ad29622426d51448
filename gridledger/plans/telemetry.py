"""Queries from message records to Silver, energy and quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gridledger.functions.scalars import time_text
from gridledger.operators import bronze as bronze_ops
from gridledger.operators import energy, gold, quality, silver
from gridledger.operators.control_tower import ingestion_lag
from gridledger.plans import tables as t
from gridledger.plans.registry import part, query
from gridledger.profiles import GENERIC, GENERIC_TELEMETRY_SCHEMA
from gridledger.sources import merge

NOW = dt.datetime(2024, 1, 30, 12, 0, 0)
CUT = "TIMESTAMP '2024-01-20 00:00:00'"
HOUR = "strftime(hour_utc, '%Y-%m-%d %H:%M:%S')"


def _r(name: str, digits: int = 6, alias: str | None = None):
    return F.round(name, digits).alias(alias or name)


@query("bronze_envelope", """
SELECT CASE WHEN k <> 6 THEN timestamp_utc END AS timestamp_utc, asset_id AS kafka_key,
  CASE WHEN k <> 6 THEN asset_id END AS asset_id,
  CASE WHEN k <> 6 THEN measured_generation_kw END AS measured_generation_kw,
  CASE WHEN k <> 6 THEN operating_status END AS operating_status,
  CASE WHEN k <> 6 THEN telemetry_quality END AS telemetry_quality,
  CAST(eid % 2 AS INTEGER) AS kafka_partition, eid AS kafka_offset,
  CASE WHEN k <> 6 THEN sha256(concat_ws('|', asset_id, timestamp_utc, eid % 2, eid))
       ELSE sha256(concat_ws('|', eid % 2, eid)) END AS event_id
FROM fields
""", ["fields"])
def bronze_envelope(spark, sf_dir):
    rows = bronze_ops.to_bronze(t.messages(spark, sf_dir))
    return rows.select(
        "timestamp_utc", "kafka_key", "asset_id", "measured_generation_kw", "operating_status", "telemetry_quality",
        "kafka_partition", "kafka_offset", "event_id",
    )


@query("schema_failures", """
SELECT count(*) AS rows_read, count(*) FILTER (WHERE k = 6) AS schema_failures FROM fields
""", ["fields"])
def schema_failures(spark, sf_dir):
    return bronze_ops.unparsed_payloads(bronze_ops.to_bronze(t.messages(spark, sf_dir)))


@query("bronze_view", """
SELECT event_id, timestamp_utc, asset_id, measured_generation_kw, expected_available_kw, grid_limit_kw, operating_status,
  telemetry_quality, source_system, kafka_topic, kafka_partition, kafka_offset,
  strftime(bronze_ingested_at, '%Y-%m-%d %H:%M:%S') AS bronze_ingested_at FROM bronze
""", ["bronze"])
def bronze_view(spark, sf_dir):
    return bronze_ops.bronze_view(t.bronze(spark, sf_dir)).withColumn("bronze_ingested_at", time_text("bronze_ingested_at"))


@query("typed_telemetry", """
SELECT kafka_offset, strftime(event_ts_utc, '%Y-%m-%d %H:%M:%S') AS event_time, asset_id, telemetry_quality FROM typed
""", ["typed"])
def typed_telemetry(spark, sf_dir):
    return silver.type_telemetry(t.bronze(spark, sf_dir)).select(
        "kafka_offset", time_text("event_ts_utc").alias("event_time"), "asset_id", "telemetry_quality"
    )


@query("incremental_bronze", """
SELECT kafka_offset, asset_id FROM bronze WHERE bronze_ingested_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 72 HOUR
""", ["bronze"])
def incremental_bronze(spark, sf_dir):
    return silver.incremental(t.bronze(spark, sf_dir), "bronze_ingested_at", NOW).select("kafka_offset", "asset_id")


@query("validation_codes", "SELECT code AS validation_error_code, count(*) AS row_count FROM validated GROUP BY 1", ["validated"])
def validation_codes(spark, sf_dir):
    return t.validated(spark, sf_dir).groupBy("validation_error_code").agg(F.count("*").alias("row_count"))


@query("silver_valid", f"""
SELECT kafka_offset, event_id, asset_id, {HOUR} AS hour_utc, measured_generation_kw, expected_available_kw, grid_limit_kw,
  operating_status FROM silver
""", ["silver"])
def silver_valid(spark, sf_dir):
    return t.silver_rows(spark, sf_dir).select(
        "kafka_offset", "event_id", "asset_id", time_text("reconciliation_hour_utc").alias("hour_utc"),
        "measured_generation_kw", "expected_available_kw", "grid_limit_kw", "operating_status",
    )


@query("silver_quarantine", """
SELECT kafka_offset, asset_id, raw_payload, code AS validation_error_code FROM validated WHERE code IS NOT NULL
""", ["validated"])
def silver_quarantine(spark, sf_dir):
    return silver.silver_quarantine(t.validated(spark, sf_dir)).select(
        "kafka_offset", "asset_id", "raw_payload", "validation_error_code"
    )


@query("validation_reasons", """
SELECT kafka_offset, CASE WHEN reasons = '' THEN 'VALID' ELSE 'INVALID' END AS dq_status, nullif(reasons, '') AS dq_error_reason
FROM (SELECT kafka_offset, concat_ws(';',
  CASE WHEN event_ts_utc IS NULL THEN 'INVALID_TIMESTAMP' END, CASE WHEN asset_id IS NULL THEN 'MISSING_ASSET' END,
  CASE WHEN NOT listed THEN 'UNKNOWN_ASSET' END,
  CASE WHEN measured_generation_kw < 0 THEN 'NEGATIVE_GENERATION' END,
  CASE WHEN expected_available_kw < 0 THEN 'NEGATIVE_EXPECTED_BASELINE' END,
  CASE WHEN grid_limit_kw < 0 THEN 'NEGATIVE_GRID_LIMIT' END,
  CASE WHEN operating_status = 'UNKNOWN' THEN 'UNKNOWN_STATUS' END,
  CASE WHEN telemetry_quality <> 'VALID' THEN telemetry_quality END) AS reasons FROM typed)
""", ["typed"])
def validation_reasons(spark, sf_dir):
    rows = silver.explain_failures(t.bronze(spark, sf_dir), known_assets=t.known_assets(spark, sf_dir))
    return rows.select("kafka_offset", "dq_status", "dq_error_reason")


@query("generic_payload_hours", """
SELECT 'A' || user_id AS asset_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_utc, count(*) AS sample_count,
  max(CASE WHEN event_type = 'purchase' THEN 'CURTAILED_BY_ISO' END) AS curtailment_status,
  round(sum(value) / 1000.0, 7) AS actual_generation_mwh
FROM events WHERE event_type <> 'error' AND NOT (event_type = 'signup' AND value > 0) GROUP BY ALL
""")
def generic_payload_hours(spark, sf_dir):
    """The second telemetry payload from message to hourly energy."""
    rows = bronze_ops.to_bronze(t.generic_messages(spark, sf_dir), GENERIC_TELEMETRY_SCHEMA)
    valid = silver.silver_valid(silver.validate(rows, GENERIC))
    return energy.hourly_energy(valid, t.SAMPLE_SECONDS, profile=GENERIC).select(
        "asset_id", time_text("reconciliation_hour_utc").alias("hour_utc"), "sample_count", "curtailment_status",
        _r("actual_generation_mwh", 7),
    )


@query("derived_metrics", """
SELECT kafka_offset, strftime(event_ts_utc, '%Y-%m-%d') AS source_date,
  operating_status LIKE 'CURTAILED_BY_%' AS is_curtailment_event,
  round(expected_available_kw * 3600.0 / 3600.0 / 1000.0, 6) AS expected_available_mwh,
  round(CASE WHEN operating_status LIKE 'CURTAILED_BY_%'
    THEN greatest((expected_available_kw - coalesce(measured_generation_kw, expected_available_kw)) / 1000.0, 0.0)
    ELSE 0.0 END, 6) AS curtailed_mwh
FROM silver
""", ["silver"])
def derived_metrics(spark, sf_dir):
    rows = silver.derive_metrics(t.silver_rows(spark, sf_dir), t.SAMPLE_SECONDS)
    return rows.select(
        "kafka_offset", F.date_format("source_date", "yyyy-MM-dd").alias("source_date"), "is_curtailment_event",
        _r("expected_available_mwh"), _r("curtailed_mwh"),
    )


@query("latest_reading", f"""
SELECT asset_id, kafka_offset, measured_generation_kw, operating_status FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY event_ts_utc DESC, kafka_offset DESC) AS n FROM silver)
WHERE n = 1
""", ["silver"])
def latest_reading(spark, sf_dir):
    rows = t.silver_rows(spark, sf_dir).select(
        "asset_id", "event_ts_utc", "kafka_offset", "measured_generation_kw", "operating_status"
    )
    return silver.latest_of_many(rows, ["asset_id"], ["event_ts_utc", "kafka_offset"]).drop("event_ts_utc")


@query("deduplicated_hours", f"""
SELECT asset_id, {HOUR} AS hour_utc, kafka_offset, operating_status FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, hour_utc ORDER BY kafka_offset) AS n FROM silver) WHERE n = 1
""", ["silver"])
def deduplicated_hours(spark, sf_dir):
    rows = t.silver_rows(spark, sf_dir).select("asset_id", "reconciliation_hour_utc", "kafka_offset", "operating_status")
    first = silver.first_of_many(rows, ["asset_id", "reconciliation_hour_utc"], ["kafka_offset"])
    return first.select("asset_id", time_text("reconciliation_hour_utc").alias("hour_utc"), "kafka_offset", "operating_status")


@query("daily_row_accounting", """
SELECT strftime(event_ts_utc, '%Y-%m-%d') AS run_date, count(*) AS rows_read, count(*) FILTER (WHERE code IS NULL) AS rows_written,
  count(*) FILTER (WHERE code IS NOT NULL) AS rows_quarantined FROM validated GROUP BY 1
""", ["validated"])
def daily_row_accounting(spark, sf_dir):
    return silver.row_accounting(t.validated(spark, sf_dir), F.date_format("event_ts_utc", "yyyy-MM-dd").alias("run_date"))


# --- energy ------------------------------------------------------------------

@query("hourly_energy", f"""
SELECT {HOUR} AS hour_utc, asset_id, curtailment_status, sample_count, round(actual_mwh, 6) AS actual_generation_mwh,
  round(expected_mwh, 6) AS expected_available_mwh, round(limited_mwh, 6) AS grid_limited_mwh FROM hourly
""", ["hourly"])
def hourly_energy(spark, sf_dir):
    return t.hourly(spark, sf_dir).select(
        time_text("reconciliation_hour_utc").alias("hour_utc"), "asset_id", "curtailment_status", "sample_count",
        _r("actual_generation_mwh"), _r("expected_available_mwh"), _r("grid_limited_mwh"),
    )


@query("hourly_energy_row_limit", f"""
SELECT {HOUR} AS hour_utc, asset_id, round(sum(least(expected_available_kw, grid_limit_kw) * 10.0 / 3600.0) / 1000.0, 9)
  AS grid_limited_mwh FROM silver GROUP BY ALL
""", ["silver"])
def hourly_energy_row_limit(spark, sf_dir):
    return energy.hourly_energy(t.silver_rows(spark, sf_dir), row_wise_limit=True).select(
        time_text("reconciliation_hour_utc").alias("hour_utc"), "asset_id", _r("grid_limited_mwh", 9)
    )


@query("five_minute_energy", """
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, event_ts_utc), '%Y-%m-%d %H:%M:%S') AS bucket_start, asset_id,
  count(*) AS sample_count, round(sum(measured_generation_kw * 3600.0 / 3600.0) / 1000.0, 6) AS actual_generation_mwh
FROM silver GROUP BY ALL
""", ["silver"])
def five_minute_energy(spark, sf_dir):
    return energy.bucket_energy(t.silver_rows(spark, sf_dir), "5 minutes", t.SAMPLE_SECONDS).select(
        time_text("bucket_start_utc").alias("bucket_start"), "asset_id", "sample_count", _r("actual_generation_mwh")
    )


@query("curtailment_episodes", """
SELECT asset_id, strftime(min(event_ts_utc), '%Y-%m-%d %H:%M:%S') AS start_utc,
  strftime(max(event_ts_utc), '%Y-%m-%d %H:%M:%S') AS end_utc, count(*) AS sample_count,
  round(sum((expected_available_kw - measured_generation_kw) / 1000.0), 6) AS curtailed_mwh
FROM (SELECT *, sum(opens) OVER (PARTITION BY asset_id ORDER BY event_ts_utc, kafka_offset) AS episode FROM (
  SELECT *, CASE WHEN date_diff('second', lag(event_ts_utc) OVER (PARTITION BY asset_id ORDER BY event_ts_utc, kafka_offset),
    event_ts_utc) <= 43200 THEN 0 ELSE 1 END AS opens
  FROM silver WHERE operating_status LIKE 'CURTAILED_BY_%'))
GROUP BY asset_id, episode
""", ["silver"])
def curtailment_episodes(spark, sf_dir):
    return energy.curtailment_episodes(t.silver_rows(spark, sf_dir), 12 * 3600, t.SAMPLE_SECONDS).select(
        "asset_id", time_text("start_utc").alias("start_utc"), time_text("end_utc").alias("end_utc"),
        "sample_count", _r("curtailed_mwh"),
    )


@query("notice_matches", """
SELECT s.kafka_offset, n.notice_id, n.reason AS notice_reason FROM silver s JOIN notices n
  ON s.asset_id = n.asset_id AND s.event_ts_utc >= n.start_utc AND s.event_ts_utc < n.end_utc
""", ["silver", "notices"])
def notice_matches(spark, sf_dir):
    rows = t.silver_rows(spark, sf_dir).select("kafka_offset", "asset_id", "event_ts_utc", "reconciliation_hour_utc")
    return energy.match_notices(rows, t.notices(spark, sf_dir)).select("kafka_offset", "notice_id", "notice_reason")


@query("notice_energy_check", """
SELECT notice_id, round(10.0 * minutes / 60, 6) AS computed_mwh, user_id % 2 = 0 AS energy_matches FROM notices
""", ["notices"])
def notice_energy_check(spark, sf_dir):
    return energy.check_notices(t.notices(spark, sf_dir)).select("notice_id", _r("computed_mwh"), "energy_matches")


@query("ingestion_lag", """
SELECT kafka_topic, count(*) AS messages,
  round(avg(date_diff('second', date_trunc('second', kafka_timestamp), bronze_ingested_at)), 6) AS avg_lag_seconds,
  max(date_diff('second', date_trunc('second', kafka_timestamp), bronze_ingested_at)) AS max_lag_seconds
FROM bronze GROUP BY 1
""", ["bronze"])
def ingestion_lag_query(spark, sf_dir):
    return ingestion_lag(t.bronze(spark, sf_dir)).withColumn("avg_lag_seconds", F.round("avg_lag_seconds", 6))


# --- keyed merges -----------------------------------------------------------

def _readings(spark, sf_dir):
    return t.silver_rows(spark, sf_dir).select("asset_id", "event_ts_utc", "kafka_offset", "measured_generation_kw")


part("early", f"""
SELECT asset_id, kafka_offset, measured_generation_kw FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY kafka_offset DESC) AS n FROM silver WHERE event_ts_utc < {CUT})
WHERE n = 1
""", ["silver"])

part("late", f"""
SELECT asset_id, kafka_offset, measured_generation_kw,
  row_number() OVER (PARTITION BY asset_id ORDER BY kafka_offset DESC) AS from_newest,
  row_number() OVER (PARTITION BY asset_id ORDER BY kafka_offset) AS from_oldest
FROM silver WHERE event_ts_utc >= {CUT}
""", ["silver"])


def _state_and_updates(spark, sf_dir):
    rows = _readings(spark, sf_dir)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp")
    state = silver.latest(rows.filter(F.col("event_ts_utc") < cut), ["asset_id"], ["kafka_offset"])
    return state, rows.filter(F.col("event_ts_utc") >= cut)


@query("upsert_latest_state", """
SELECT asset_id, kafka_offset, measured_generation_kw FROM late WHERE from_newest = 1
UNION ALL
SELECT * FROM early WHERE asset_id NOT IN (SELECT asset_id FROM late)
""", ["early", "late"])
def upsert_latest_state(spark, sf_dir):
    state, updates = _state_and_updates(spark, sf_dir)
    merged = merge.upsert(state, updates, ["asset_id"], ["kafka_offset"])
    return merged.select("asset_id", "kafka_offset", "measured_generation_kw")


@query("insert_if_absent", """
SELECT * FROM early
UNION ALL
SELECT asset_id, kafka_offset, measured_generation_kw FROM late
WHERE from_oldest = 1 AND asset_id NOT IN (SELECT asset_id FROM early)
""", ["early", "late"])
def insert_if_absent(spark, sf_dir):
    state, updates = _state_and_updates(spark, sf_dir)
    merged = merge.insert_ignore(state, updates, ["asset_id"], ["kafka_offset"])
    return merged.select("asset_id", "kafka_offset", "measured_generation_kw")


# --- data quality --------------------------------------------------------------

SILVER_SPEC = [
    {"row_count": "positive"},
    {"missing": "event_id"},
    {"missing": "event_ts_utc"},
    {"missing": "asset_id"},
    {"unique": ["event_id"]},
    {"failed_rows": "measured generation must be non-negative", "where": "measured_generation_kw < 0"},
    {"failed_rows": "expected generation must be non-negative", "where": "expected_available_kw < 0"},
]


@query("silver_quality_checks", """
SELECT 'validated' AS dataset, check_name, failed_count = 0 AS passed, failed_count FROM (
  SELECT 'row_count > 0' AS check_name, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS failed_count FROM validated UNION
  SELECT 'missing_count(event_id) = 0', count(*) FILTER (WHERE event_id IS NULL) FROM validated UNION
  SELECT 'missing_count(event_ts_utc) = 0', count(*) FILTER (WHERE event_ts_utc IS NULL) FROM validated UNION
  SELECT 'missing_count(asset_id) = 0', count(*) FILTER (WHERE asset_id IS NULL) FROM validated UNION
  SELECT 'duplicate_count(event_id) = 0', (SELECT count(*) FROM (SELECT event_id FROM validated GROUP BY 1 HAVING count(*) > 1)) UNION
  SELECT 'measured generation must be non-negative', count(*) FILTER (WHERE measured_generation_kw < 0) FROM validated UNION
  SELECT 'expected generation must be non-negative', count(*) FILTER (WHERE expected_available_kw < 0) FROM validated)
""", ["validated"])
def silver_quality_checks(spark, sf_dir):
    """Run on the rows before quarantine, so that checks fail."""
    checks = quality.checks_from_spec(SILVER_SPEC)
    return quality.run_checks(t.validated(spark, sf_dir), "validated", checks).drop("checked_at")


def gold_checks():
    return [
        quality.row_count_positive(), quality.not_missing("fact_record_hash"), quality.unique("fact_record_hash"),
        quality.non_negative("expected_available_mwh"), quality.non_negative("actual_generation_mwh"),
        quality.non_negative("grid_curtailment_mwh"), quality.non_negative("estimated_leakage_revenue_usd"),
        quality.accepted("iso_region", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]), quality.compensable_consistent(),
    ]


@query("gold_quality_gate", """
SELECT 'gold' AS dataset, CASE WHEN count(*) FILTER (WHERE n > 0) = 0 THEN 'PASSED' ELSE 'FAILED' END AS dq_gate_status,
  count(*) FILTER (WHERE n > 0) AS failed_checks
FROM (SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS n FROM gold UNION ALL
  SELECT count(*) FILTER (WHERE fact_record_hash IS NULL) AS n FROM gold UNION ALL
  SELECT count(*) AS n FROM (SELECT fact_record_hash FROM gold GROUP BY 1 HAVING count(*) > 1) UNION ALL
  SELECT count(*) FILTER (WHERE expected_mwh < 0) AS n FROM gold UNION ALL
  SELECT count(*) FILTER (WHERE actual_mwh < 0) AS n FROM gold UNION ALL
  SELECT count(*) FILTER (WHERE grid_curtailment_mwh < 0) AS n FROM gold UNION ALL
  SELECT count(*) FILTER (WHERE leakage_usd < 0) AS n FROM gold UNION ALL
  SELECT count(*) FILTER (WHERE iso_region NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')) AS n FROM gold UNION ALL
  SELECT count(*) FILTER (WHERE eligible_mwh > grid_curtailment_mwh OR (curtailment_compensable_flag <> 'Y' AND eligible_mwh <> 0)) AS n FROM gold)
""", ["gold"])
def gold_quality_gate(spark, sf_dir):
    return quality.gate(quality.run_checks(t.stored_gold(spark, sf_dir), "gold", gold_checks()))


@query("duplicate_line_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_line_keys(spark, sf_dir):
    return quality.duplicate_keys(t.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("silver_split_is_whole", """
SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, count(*) AS source_rows FROM bronze
""", ["bronze"])
def silver_split_is_whole(spark, sf_dir):
    rows = t.validated(spark, sf_dir).select("asset_id", "event_id", "event_ts_utc", "validation_error_code")
    difference = quality.partition_difference(rows, silver.silver_valid(rows), silver.silver_quarantine(rows), "event_id")
    whole = rows.agg(F.lit("source").alias("side"), F.count("*").alias("copies"))
    counted = difference.select("side", "copies").unionByName(whole)

    def copies(side: str):
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("copies"))), F.lit(0))

    return counted.agg(copies("lost").alias("lost"), copies("added").alias("added"), copies("source").alias("source_rows"))


@query("unmapped_assets", """
SELECT s.asset_id, count(*) AS sample_count FROM silver s WHERE s.asset_id NOT IN (SELECT site_identity_tag FROM contracts)
GROUP BY 1
""", ["silver", "contracts"])
def unmapped_assets(spark, sf_dir):
    return gold.unmapped_assets(t.silver_rows(spark, sf_dir), t.contracts(spark, sf_dir)).select("asset_id", "sample_count")
