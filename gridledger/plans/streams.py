"""Queries that drain a stream of the given events into tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions.scalars import time_text
from gridledger.functions.skew import dealt
from gridledger.operators import bronze as bronze_ops
from gridledger.operators import silver
from gridledger.plans import tables as t
from gridledger.plans.registry import part, query
from gridledger.profiles import GENERIC, GENERIC_TELEMETRY_SCHEMA
from gridledger.session import work_path
from gridledger.streaming import jobs

_EVENTS = "events.parquet"


def _events(spark, sf_dir):
    return jobs.file_stream(spark, sf_dir, t.read(spark, sf_dir, "events").schema, _EVENTS)


def _bronze(spark, sf_dir):
    return t.bronze_from(_events(spark, sf_dir))


def _silver(spark, sf_dir):
    """Clean rows as a stream; the asset registry is a static side."""
    rows = silver.validate(_bronze(spark, sf_dir), known_assets=t.known_assets(spark, sf_dir))
    return silver.silver_valid(rows)


def _drain(spark, stream, name: str):
    """Run to the end of the source and read what was written."""
    path = work_path(spark, name)
    query_ = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True).start(path)
    )
    jobs.drain(query_)
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_bronze_landing", """
SELECT CASE WHEN k <> 6 THEN asset_id END AS asset_id, eid AS kafka_offset, CASE WHEN k <> 6 THEN timestamp_utc END AS timestamp_utc,
  CASE WHEN k <> 6 THEN measured_generation_kw END AS measured_generation_kw FROM fields
""", ["fields"])
def stream_bronze_landing(spark, sf_dir):
    messages = t.messages_from(_events(spark, sf_dir))
    stream = bronze_ops.to_bronze(messages).withColumn("landing_date", F.to_date("kafka_timestamp"))
    path = work_path(spark, "bronze")
    jobs.drain(jobs.write_bronze(stream, path, path + "-checkpoint", ("landing_date",)))
    return spark.read.schema(stream.schema).parquet(path).select(
        "asset_id", "kafka_offset", "timestamp_utc", "measured_generation_kw"
    )


@query("stream_silver_split", """
SELECT kafka_offset, coalesce(code, 'VALID') AS outcome FROM validated
""", ["validated"])
def stream_silver_split(spark, sf_dir):
    path = work_path(spark, "silver")
    jobs.run_silver(
        _bronze(spark, sf_dir), path + "/valid", path + "/quarantine", path + "/checkpoint",
        known_assets=t.known_assets(spark, sf_dir),
    )
    valid = spark.read.parquet(path + "/valid").select("kafka_offset", F.lit("VALID").alias("outcome"))
    bad = spark.read.parquet(path + "/quarantine").select("kafka_offset", F.col("validation_error_code").alias("outcome"))
    return valid.unionByName(bad)


@query("stream_deduplicated", "SELECT event_id, asset_id FROM silver", ["silver"])
def stream_deduplicated(spark, sf_dir):
    rows = _silver(spark, sf_dir).select("event_id", "asset_id", "event_ts_utc")
    doubled = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _drain(spark, jobs.dedupe_stream(doubled), "dedupe").select("event_id", "asset_id")


part("watermark", "SELECT max(event_ts_utc) - INTERVAL 72 HOUR AS mark FROM silver", ["silver"])


def _bucket_sql(width: str) -> str:
    return f"""
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket_start, asset_id, sample_count, actual_generation_mwh FROM (
  SELECT time_bucket(INTERVAL {width}, event_ts_utc) AS b, asset_id, count(*) AS sample_count,
    round(sum(measured_generation_kw * 3600.0 / 3600.0) / 1000.0, 6) AS actual_generation_mwh FROM silver GROUP BY 1, 2), watermark
WHERE b + INTERVAL {width} <= mark
"""


def _buckets(spark, stream, name: str):
    return _drain(spark, stream, name).select(
        time_text("bucket_start_utc").alias("bucket_start"), "asset_id", "sample_count",
        F.round("actual_generation_mwh", 6).alias("actual_generation_mwh"),
    )


@query("stream_hourly_energy", _bucket_sql("1 HOUR"), ["silver", "watermark"])
def stream_hourly_energy(spark, sf_dir):
    """Hours closed by the watermark; the last 72 hours are still open."""
    stream = jobs.stream_hourly(_silver(spark, sf_dir), sample_seconds=t.SAMPLE_SECONDS)
    return _buckets(spark, stream, "hourly")


@query("stream_five_minute_energy", _bucket_sql("5 MINUTE"), ["silver", "watermark"])
def stream_five_minute_energy(spark, sf_dir):
    stream = jobs.stream_bucket(_silver(spark, sf_dir), "5 minutes", sample_seconds=t.SAMPLE_SECONDS)
    return _buckets(spark, stream, "five-minute")


@query("stream_generic_hours", """
SELECT asset_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS hour_utc, sample_count, curtailment_status, actual_generation_mwh FROM (
  SELECT 'A' || user_id AS asset_id, date_trunc('hour', ts) AS b, count(*) AS sample_count,
    max(CASE WHEN event_type = 'purchase' THEN 'CURTAILED_BY_ISO' END) AS curtailment_status,
    round(sum(value) / 1000.0, 7) AS actual_generation_mwh
  FROM events WHERE event_type <> 'error' AND NOT (event_type = 'signup' AND value > 0) GROUP BY ALL)
WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events
  WHERE event_type <> 'error' AND NOT (event_type = 'signup' AND value > 0)) - INTERVAL 72 HOUR
""")
def stream_generic_hours(spark, sf_dir):
    """The second telemetry payload as a stream, from message to closed hours."""
    rows = bronze_ops.to_bronze(t.generic_messages_from(_events(spark, sf_dir)), GENERIC_TELEMETRY_SCHEMA)
    valid = silver.silver_valid(silver.validate(rows, GENERIC))
    stream = jobs.stream_hourly(valid, sample_seconds=t.SAMPLE_SECONDS, profile=GENERIC)
    return _drain(spark, stream, "generic").select(
        "asset_id", time_text("bucket_start_utc").alias("hour_utc"), "sample_count", "curtailment_status",
        F.round("actual_generation_mwh", 7).alias("actual_generation_mwh"))


@query("stream_enriched", """
SELECT kafka_offset, s.asset_id, a.iso_region, c.associated_ppa_id FROM silver s JOIN assets a USING (asset_id)
LEFT JOIN contracts c ON c.site_identity_tag = s.asset_id
""", ["silver", "assets", "contracts"])
def stream_enriched(spark, sf_dir):
    rows = jobs.enrich_stream(_silver(spark, sf_dir), t.assets(spark, sf_dir), t.contracts(spark, sf_dir))
    return _drain(spark, rows.select("kafka_offset", "asset_id", "iso_region", "associated_ppa_id"), "enriched")


@query("stream_curtailment_sessions", """
SELECT asset_id, strftime(min(event_ts_utc), '%Y-%m-%d %H:%M:%S') AS start_utc, count(*) AS sample_count,
  round(sum((expected_available_kw - measured_generation_kw) / 1000.0), 6) AS curtailed_mwh
FROM (SELECT *, sum(opens) OVER (PARTITION BY asset_id ORDER BY event_ts_utc, kafka_offset) AS episode FROM (
  SELECT *, CASE WHEN date_diff('second', lag(event_ts_utc) OVER (PARTITION BY asset_id ORDER BY event_ts_utc, kafka_offset),
    event_ts_utc) <= 43200 THEN 0 ELSE 1 END AS opens FROM silver WHERE operating_status LIKE 'CURTAILED_BY_%')), watermark
GROUP BY asset_id, episode, mark HAVING max(event_ts_utc) + INTERVAL 12 HOUR <= mark
""", ["silver", "watermark"])
def stream_curtailment_sessions(spark, sf_dir):
    stream = jobs.stream_sessions(_silver(spark, sf_dir), "12 hours", sample_seconds=t.SAMPLE_SECONDS)
    return _drain(spark, stream, "sessions").select(
        "asset_id", time_text("start_utc").alias("start_utc"), "sample_count",
        F.round("curtailed_mwh", 6).alias("curtailed_mwh"),
    )


def _land_part(spark, events, path: str, n: int):
    """A third of the events, and a third of the earlier ones again; hours of earlier parts get late rows."""
    turn = F.pmod(F.col("event_id"), F.lit(3))
    again = events.filter((turn < n) & (F.pmod(F.col("event_id"), F.lit(9)) < 3))
    # Dealt out, so that a stream over the files is read by more tasks than the table has parts.
    dealt(events.filter(turn == n).unionByName(again)).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, events.schema)


@query("stream_gold_remerge", """
SELECT fact_record_hash, sample_count, round(leakage_usd, 6) AS estimated_leakage_revenue_usd FROM gold
""", ["gold"])
def stream_gold_remerge(spark, sf_dir):
    """Events in three parts with late and repeated rows; the fact is merged after each."""
    path = work_path(spark, "gold")
    valid, dims = path + "/silver", t.gold_dims(spark, sf_dir)
    events, assets = t.read(spark, sf_dir, "events"), t.known_assets(spark, sf_dir)
    for n in range(3):
        part_ = t.bronze_from(_land_part(spark, events, path + "/events", n))
        jobs.run_silver(part_, valid, path + "/quarantine", path + "/silver-checkpoint", known_assets=assets)
        schema = spark.read.parquet(valid).schema
        jobs.run_gold(
            jobs.file_stream(spark, valid, schema), lambda: spark.read.schema(schema).parquet(valid),
            dims, path + "/fact", path + "/gold-checkpoint", t.SAMPLE_SECONDS,
        )
    return spark.read.parquet(path + "/fact").select(
        "fact_record_hash", "sample_count",
        F.round("estimated_leakage_revenue_usd", 6).alias("estimated_leakage_revenue_usd"),
    )


@query("stream_batch_metrics", """
SELECT kafka_offset % 3 AS batch_id, count(*) AS input_rows, strftime(max(kafka_timestamp), '%Y-%m-%d %H:%M:%S') AS newest,
  max(date_diff('second', date_trunc('second', kafka_timestamp), bronze_ingested_at)) AS max_lag_seconds FROM bronze GROUP BY 1
""", ["bronze"])
def stream_batch_metrics(spark, sf_dir):
    """Rows, newest broker time and longest lag of three micro-batches, observed while they are written."""
    path = work_path(spark, "metrics")
    events = t.read(spark, sf_dir, "events")
    for n in range(3):
        events.filter(F.pmod(F.col("event_id"), F.lit(3)) == n).write.mode("append").parquet(path + "/events")
        stream = t.bronze_from(jobs.file_stream(spark, path + "/events", events.schema, files_per_batch=1_000_000))
        jobs.land_batches(stream, path + "/landed", path + "/checkpoint", "kafka_timestamp", "bronze_ingested_at")
    return jobs.batch_metrics(spark, path + "/landed").select(
        F.col("batch_id").cast("long").alias("batch_id"), "input_rows", time_text("newest").alias("newest"), "max_lag_seconds")


@query("stream_silver_redelivery", """
SELECT kafka_offset, coalesce(code, 'VALID') AS outcome FROM validated WHERE event_id IS NOT NULL
""", ["validated"])
def stream_silver_redelivery(spark, sf_dir):
    """Events in three batches, a third of them delivered again in each later batch."""
    path = work_path(spark, "redelivery")
    events = t.read(spark, sf_dir, "events")
    for n in range(3):
        jobs.run_silver(
            t.bronze_from(_land_part(spark, events, path + "/events", n)), path + "/valid", path + "/quarantine",
            path + "/checkpoint", known_assets=t.known_assets(spark, sf_dir))
    valid = spark.read.parquet(path + "/valid").select("event_id", "kafka_offset", F.lit("VALID").alias("outcome"))
    bad = spark.read.parquet(path + "/quarantine").select(
        "event_id", "kafka_offset", F.col("validation_error_code").alias("outcome"))
    return valid.unionByName(bad).filter(F.col("event_id").isNotNull()).drop("event_id")
