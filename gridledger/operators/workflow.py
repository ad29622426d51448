"""Guards, approvals and the CRM outbox as table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger import fixed_values as fv
from gridledger.functions.scalars import (
    float_text, json_text, let, list_text, non_null, priority, rough_tokens,
)
from gridledger.operators.silver import latest
from gridledger.profiles import VERDICT_SCHEMA


def validate_verdict(text: Column) -> Column:
    """Messages for a verdict that is not JSON, lacks or adds fields, or has a bad priority."""
    raw = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    wanted = F.array(*[F.lit(f) for f in fv.VERDICT_FIELDS])

    def messages(fields: Column) -> Column:
        names = F.map_keys(fields)
        lacking = F.transform(F.array_except(wanted, names), lambda n: F.concat(F.lit("missing field: "), n))
        extra = F.transform(F.array_sort(F.array_except(names, wanted)), lambda n: F.concat(F.lit("unexpected field: "), n))
        level = F.try_element_at(fields, F.lit("recommended_case_priority"))
        bad = F.when(level.isNotNull() & ~level.isin(*fv.PRIORITIES), F.concat(F.lit("invalid priority: "), level))
        return F.concat(lacking, extra, non_null([bad]))

    return let(raw, lambda f: F.when(F.coalesce(F.size(f), F.lit(0)) <= 0, F.array(F.lit("not a JSON object"))).otherwise(messages(f)))


def parse_verdict(text: Column) -> Column:
    return F.from_json(text, VERDICT_SCHEMA)


def enforce_gold(verdicts: DataFrame) -> DataFrame:
    """The fact's amount and contract replace whatever a verdict says.

    Expects the event columns ``event_variance_usd`` and ``event_contract_id``.
    """
    return verdicts.withColumns({
        "audited_variance_usd": F.coalesce("event_variance_usd", F.lit(0.0)),
        "contract_id": F.col("event_contract_id"),
    })


def guard(cases: DataFrame, min_similarity: float = fv.MIN_SIMILARITY) -> DataFrame:
    """Adds ``guardrail_failures`` and ``guardrail_passed``.

    One row per case with event_contract_id, event_variance_usd, the verdict
    columns contract_id, audited_variance_usd, dispute_warranted and
    supporting_chunk_ids, and an ``evidence`` array (null when none).
    """
    evidence = F.coalesce("evidence", F.array().cast(cases.schema["evidence"].dataType))
    known = F.transform(evidence, lambda e: e["chunk_id"])
    foreign = F.transform(
        F.filter(evidence, lambda e: ~e["contract_id"].eqNullSafe(F.col("event_contract_id"))), lambda e: e["chunk_id"]
    )
    best = F.coalesce(F.array_max(F.transform(evidence, lambda e: F.coalesce(e["similarity"], F.lit(0.0)))), F.lit(0.0))
    cited = F.coalesce("supporting_chunk_ids", F.array().cast("array<bigint>"))
    unknown = F.array_sort(F.array_except(cited, known))
    variance = F.coalesce("event_variance_usd", F.lit(0.0))
    failures = non_null([
        F.when(F.size(evidence) == 0, fv.MSG_NO_CHUNKS),
        F.when(F.size(foreign) > 0, F.concat(F.lit(fv.MSG_WRONG_CONTRACT), list_text(foreign))),
        F.when(best < min_similarity, F.format_string(fv.MSG_LOW_SIMILARITY, best, F.lit(min_similarity))),
        F.when(~F.col("contract_id").eqNullSafe(F.col("event_contract_id")), fv.MSG_CONTRACT_MISMATCH),
        F.when(
            F.abs(F.coalesce("audited_variance_usd", F.lit(0.0)) - variance) > fv.VARIANCE_TOLERANCE_USD,
            fv.MSG_VARIANCE_MISMATCH,
        ),
        F.when(F.col("dispute_warranted") & (F.size(cited) == 0), fv.MSG_NO_CITATIONS),
        F.when(F.size(unknown) > 0, F.concat(F.lit(fv.MSG_UNKNOWN_CITATIONS), list_text(unknown))),
    ])
    return cases.withColumn("guardrail_failures", failures).withColumn(
        "guardrail_passed", F.size("guardrail_failures") == 0
    )


def guard_by_location(cases: DataFrame) -> DataFrame:
    """The guard that cites (page, chunk index) and compares cents.

    Verdict columns: contract_id, variance_confirmed_usd, dispute_required and
    ``cited`` array<struct<page_number, chunk_index>>.
    """
    evidence = F.coalesce("evidence", F.array().cast(cases.schema["evidence"].dataType))
    places = F.transform(evidence, lambda e: F.struct(e["page_number"].alias("page_number"), e["chunk_index"].alias("chunk_index")))
    cited = F.coalesce("cited", F.array().cast("array<struct<page_number:int,chunk_index:int>>"))
    unknown = F.filter(cited, lambda c: ~F.array_contains(places, c))
    required = F.coalesce("dispute_required", F.lit(False))
    variance = F.round(F.coalesce("event_variance_usd", F.lit(0.0)), 2)
    confirmed = F.round(F.coalesce("variance_confirmed_usd", F.lit(-1.0)), 2)
    failures = F.concat(
        non_null([
            F.when(~F.col("contract_id").eqNullSafe(F.col("event_contract_id")), fv.MSG_ALT_CONTRACT),
            F.when(required & (variance != confirmed), fv.MSG_ALT_VARIANCE),
            F.when(required & (F.size(evidence) == 0), fv.MSG_ALT_NO_EVIDENCE),
        ]),
        F.transform(unknown, lambda c: F.format_string(fv.MSG_ALT_REFERENCE, c["page_number"], c["chunk_index"])),
    )
    return cases.withColumn("guardrail_failures", failures).withColumn(
        "guardrail_passed", F.size("guardrail_failures") == 0
    )


def approval_queue(cases: DataFrame, high_value_usd: float = fv.HIGH_VALUE_USD) -> DataFrame:
    """Pending requests for guarded cases with a warranted dispute."""
    return cases.filter(F.col("guardrail_passed") & F.col("dispute_warranted")).select(
        F.concat(F.lit("APR-"), "execution_id").alias("approval_id"),
        "execution_id",
        F.lit(fv.APPROVAL_TYPE).alias("approval_type"),
        (F.coalesce("event_variance_usd", F.lit(0.0)) >= high_value_usd).alias("high_value_flag"),
        "asset_id",
        F.col("event_contract_id").alias("contract_id"),
        "fact_record_hash",
        F.coalesce("event_variance_usd", F.lit(0.0)).alias("variance_usd"),
        F.col("recommended_case_priority").alias("recommended_priority"),
        F.col("salesforce_case_subject").alias("case_subject"),
        F.col("salesforce_case_description").alias("case_description"),
        "evidence",
        F.lit(fv.APPROVAL_INSTRUCTIONS).alias("instructions"),
        F.lit(fv.PENDING).alias("approval_status"),
    )


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The newest decision per request; edits replace subject and description when not empty."""
    newest = latest(
        decisions.select("approval_id", "approved", "edited_case_subject", "edited_case_description", "decided_at"),
        ["approval_id"], ["decided_at", "approved"],
    )
    status = (
        F.when(F.col("decided_at").isNull(), fv.PENDING).when(F.col("approved"), fv.APPROVED).otherwise(fv.REJECTED)
    )

    def edited(edit: str, original: str) -> Column:
        return F.coalesce(F.nullif(F.col(edit), F.lit("")), F.col(original))

    return (
        queue.drop("approval_status").join(newest, "approval_id", "left")
        .withColumns({
            "approval_status": status,
            "case_subject": edited("edited_case_subject", "case_subject"),
            "case_description": edited("edited_case_description", "case_description"),
        })
        .drop("edited_case_subject", "edited_case_description", "approved")
    )


def terminal_status() -> Column:
    """End state of a case from guard, verdict, approval and dispatch.

    A request without a decision stays pending and a case may have no request.
    """
    approval, sent = F.col("approval_status"), F.col("dispatch_success")
    return (
        F.when(~F.col("guardrail_passed"), fv.TERMINAL_QUARANTINED)
        .when(~F.coalesce("dispute_warranted", F.lit(False)), fv.TERMINAL_NO_DISPUTE)
        .when(approval == fv.REJECTED, fv.TERMINAL_QUARANTINED)
        .when(approval == fv.PENDING, fv.PENDING.lower())
        .when(approval.isNull(), fv.TERMINAL_NO_APPROVAL)
        .when(sent, fv.TERMINAL_CREATED)
        .otherwise(fv.TERMINAL_FAILED)
    )


def crm_outbox(decided: DataFrame, platform: str = "Revenue assurance") -> DataFrame:
    """Case records to send, for approved requests only."""
    description = F.coalesce(
        F.nullif("case_description", F.lit("")), F.col("compliance_justification_rationale"), F.lit("")
    )
    ids = F.coalesce("supporting_chunk_ids", F.array().cast("array<bigint>")).cast("array<string>")
    listed = F.when(F.size(ids) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n    "), F.array_join(ids, ",\n    "), F.lit("\n  ]"))
    )
    metadata = F.concat(
        F.lit('{\n  "asset_id": '), json_text(F.col("asset_id")),
        F.lit(',\n  "contract_id": '), json_text(F.col("contract_id")),
        F.lit(',\n  "fact_record_hash": '), json_text(F.col("fact_record_hash")),
        F.lit(',\n  "dispute_value_usd": '), float_text("variance_usd"),
        F.lit(',\n  "evidence_chunk_ids": '), listed, F.lit("\n}"),
    )
    subject = F.coalesce(
        F.nullif("case_subject", F.lit("")), F.concat(F.lit(fv.DEFAULT_SUBJECT + ": "), "asset_id")
    )
    return decided.filter(F.col("approval_status") == fv.APPROVED).select(
        "execution_id",
        subject.alias("Subject"),
        priority("recommended_priority").alias("Priority"),
        F.lit(f"{platform} Platform").alias("Origin"),
        F.concat(description, F.lit(f"\n\n{platform} audit metadata:\n"), metadata).alias("Description"),
        F.lit("New").alias("Status"),
    )


def mock_actions(decided: DataFrame) -> DataFrame:
    """Simulated CRM action of approved requests, by recommended action."""
    action = F.col("recommended_next_action")
    return decided.filter(F.col("approval_status") == fv.APPROVED).withColumn(
        "mock_action_type",
        F.when(action == fv.ACTION_READY, fv.MOCK_CREATE)
        .when(action == fv.ACTION_UPDATE, fv.MOCK_UPDATE)
        .otherwise(fv.MOCK_REVIEW),
    )


def audit_log(cases: DataFrame, payload: list[str], synthesis: list[str], at: Column | None = None) -> DataFrame:
    """One audit record per execution."""
    evidence = F.coalesce("evidence", F.array().cast(cases.schema["evidence"].dataType))
    return cases.select(
        "execution_id", "fact_record_hash",
        F.col("event_contract_id").alias("contract_id"),
        "document_version_hash", "asset_id",
        F.to_json(F.struct(*payload)).alias("breach_event_payload"),
        F.transform(evidence, lambda e: e["chunk_id"]).alias("retrieved_chunk_ids"),
        F.to_json(F.struct(*synthesis)).alias("synthesis_output"),
        F.to_json("guardrail_failures").alias("guardrail_failures"),
        F.coalesce(F.col("approval_status") == fv.APPROVED, F.lit(False)).alias("human_authorized_release"),
        F.col("crm_case_id"),
        F.coalesce("terminal_status", F.lit("unknown")).alias("terminal_status"),
        (F.current_timestamp() if at is None else at).alias("created_at_timestamp"),
    )


def token_metrics(prompts: DataFrame, prompt: str, compressed: str | None = None, threshold: int = fv.TOKEN_THRESHOLD) -> DataFrame:
    """Tokens before and after compression; counted as enabled only from the threshold on."""
    before = rough_tokens(prompt)
    enabled = (before >= threshold) & (F.col(compressed).isNotNull() if compressed else F.lit(False))
    after = F.when(enabled, rough_tokens(compressed)).otherwise(before) if compressed else before
    return prompts.withColumns({
        "headroom_enabled": enabled,
        "headroom_tokens_before": before,
        "headroom_tokens_after": after,
        "headroom_tokens_saved": F.greatest(before - after, F.lit(0)),
    })


def dispatch_allowed(material_usd: float = 0.0) -> Column:
    """Positive and material variance, evidence, passed guard and an approval."""
    return (
        (F.coalesce("event_variance_usd", F.lit(0.0)) > material_usd)
        & (F.coalesce(F.size("evidence"), F.lit(0)) > 0)
        & F.col("guardrail_passed")
        & F.coalesce(F.col("approval_status") == fv.APPROVED, F.lit(False))
    )


def retain(records: DataFrame, as_of: Column, created: str = "created_at_timestamp", days: int = fv.RETENTION_DAYS) -> DataFrame:
    return records.filter(F.col(created) >= as_of - F.make_dt_interval(days=F.lit(days)))
