"""Raw telemetry: message envelope to flat Bronze rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.functions.scalars import hash_key
from gridledger.profiles import TELEMETRY_SCHEMA


def to_bronze(messages: DataFrame, schema: T.StructType = TELEMETRY_SCHEMA) -> DataFrame:
    """Flatten message records; unparseable payloads keep their raw text and null fields.

    Works on batch and streaming input with the columns key, value, topic,
    partition, offset and timestamp.
    """
    body = F.col("value").cast("string")
    flat = messages.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        body.alias("raw_payload"),
        F.from_json(body, schema).alias("data"),
    ).select(
        "kafka_key", "kafka_topic", "kafka_partition", "kafka_offset",
        "kafka_timestamp", "raw_payload", "data.*",
    ).withColumn("bronze_ingested_at", F.current_timestamp())
    if "event_id" in flat.columns:
        return flat
    return flat.withColumn(
        "event_id", hash_key("asset_id", "timestamp_utc", "kafka_partition", "kafka_offset")
    )


def bronze_view(bronze: DataFrame) -> DataFrame:
    """The published Bronze columns, without payload text and message keys."""
    return bronze.select(
        "event_id", "timestamp_utc", "asset_id", "measured_generation_kw",
        "expected_available_kw", "grid_limit_kw", "operating_status", "telemetry_quality",
        "source_system", "kafka_topic", "kafka_partition", "kafka_offset", "bronze_ingested_at",
    )


def unparsed_payloads(bronze: DataFrame, schema: T.StructType = TELEMETRY_SCHEMA) -> DataFrame:
    """Count of rows whose payload text yielded no field at all."""
    empty = F.lit(True)
    for name in schema.names:
        empty = empty & F.col(name).isNull()
    return bronze.agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.col("raw_payload").isNotNull() & empty).alias("schema_failures"),
    )
