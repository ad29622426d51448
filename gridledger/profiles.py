"""Schemas, telemetry profiles and zone layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from gridledger import fixed_values as fv

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("asset_id", T.StringType()),
    T.StructField("measured_generation_kw", T.DoubleType()),
    T.StructField("expected_available_kw", T.DoubleType()),
    T.StructField("grid_limit_kw", T.DoubleType()),
    T.StructField("operating_status", T.StringType()),
    T.StructField("telemetry_quality", T.StringType()),
    T.StructField("source_system", T.StringType()),
])

GENERIC_TELEMETRY_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("source_system", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("asset_id", T.StringType()),
    T.StructField("asset_type", T.StringType()),
    T.StructField("iso_region", T.StringType()),
    T.StructField("nameplate_mw", T.IntegerType()),
    T.StructField("expected_available_kw", T.DoubleType()),
    T.StructField("actual_generation_kw", T.DoubleType()),
    T.StructField("operating_status", T.StringType()),
    T.StructField("curtailment_reason", T.StringType()),
    T.StructField("market_price_usd_per_mwh", T.DoubleType()),
])

RUNTIME_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("component_name", T.StringType()),
    T.StructField("node_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("rag_run_id", T.StringType()),
    T.StructField("created_at_utc", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])

EVIDENCE_TYPE = T.ArrayType(T.StructType([
    T.StructField("context_rank", T.IntegerType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("evidence_role", T.StringType()),
    T.StructField("evidence_score", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk_text", T.StringType()),
]))

CASE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "breach_event_id", "asset_id", "asset_name", "asset_type", "contract_id",
        "offtaker_name", "curtailment_reason")]
    + [T.StructField("eligible_compensable_mwh", T.DoubleType()),
       T.StructField("estimated_leakage_revenue_usd", T.DoubleType())]
    + [T.StructField(name, T.StringType()) for name in (
        "breach_severity", "invoice_id", "invoice_status")]
    + [T.StructField("open_amount_usd", T.DoubleType())]
    + [T.StructField(name, T.StringType()) for name in (
        "accounting_doc_id", "gl_account", "profit_center", "sf_account_id",
        "account_name", "sf_contract_id")]
    + [T.StructField("existing_open_dispute_flag", T.BooleanType())]
    + [T.StructField(name, T.StringType()) for name in (
        "existing_dispute_number", "recommended_next_action")]
    + [T.StructField("evidence_context", EVIDENCE_TYPE)]
)

NOTICE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "notice_id", "iso", "asset_id", "resource_id", "settlement_point",
        "curtailment_reason", "constraint_name")]
    + [T.StructField("start_time_utc", T.TimestampType()),
       T.StructField("end_time_utc", T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in (
        "expected_available_mw", "actual_output_mw", "curtailed_mwh")]
    + [T.StructField("related_contract_id", T.StringType())]
)

VERDICT_SCHEMA = T.StructType([
    T.StructField("dispute_warranted", T.BooleanType()),
    T.StructField("audited_variance_usd", T.DoubleType()),
    T.StructField("contract_id", T.StringType()),
    T.StructField("supporting_chunk_ids", T.ArrayType(T.LongType())),
    T.StructField("compliance_justification_rationale", T.StringType()),
    T.StructField("recommended_case_priority", T.StringType()),
    T.StructField("salesforce_case_subject", T.StringType()),
    T.StructField("salesforce_case_description", T.StringType()),
])


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


@dataclass(frozen=True)
class TelemetryProfile:
    """How one telemetry payload maps to the common column names.

    ``asset_ids`` is a short allow-list; a large registry is passed to the
    validators as a DataFrame instead. ``strict`` adds MISSING_* codes for
    nulls that SQL comparisons let through.
    """

    statuses: tuple[str, ...] = fv.OPERATING_STATUSES
    asset_ids: tuple[str, ...] | None = None
    time_format: str = fv.TELEMETRY_TIME_FORMAT
    renames: dict[str, str] = field(default_factory=dict)
    has_quality: bool = True
    strict: bool = False


METERED = TelemetryProfile()
GENERIC = TelemetryProfile(
    statuses=fv.GENERIC_STATUSES,
    time_format="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    renames={"actual_generation_kw": "measured_generation_kw"},
    has_quality=False,
)

ZONES = ("bronze", "silver", "gold", "quarantine", "observability")


def zone_path(root: str, zone: str, table: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"unknown zone: {zone}")
    return f"{root.rstrip('/')}/{zone}/{table}"
