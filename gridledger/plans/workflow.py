"""Queries on guards, approvals and dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions.scalars import float_text, rough_tokens
from gridledger.operators import retrieval
from gridledger.operators import workflow as ops
from gridledger.plans import tables as t
from gridledger.plans.registry import part, query
from gridledger.session import materialize

AS_OF = "2001-08-01 00:00:00"


def verdict_cases(spark, sf_dir):
    """A verdict per vector event; each contract's verdicts carry another flaw."""
    events = t.vector_events(spark, sf_dir)
    label, key = F.col("label"), F.col("vec_id")
    asked = events.withColumn("document_version_hash", F.when(label == 7, "gone"))
    packs = retrieval.evidence_array(retrieval.retrieve_context(asked, t.vector_chunks(spark, sf_dir)))
    shown = F.when(
        label == 8, F.transform("evidence", lambda e: e.withField("contract_id", F.lit("other")))
    ).when(
        label == 2, F.transform("evidence", lambda e: e.withField("similarity", e["similarity"] * 0.5))
    ).otherwise(F.col("evidence"))
    variance = key * 20.0
    none = F.array().cast("array<bigint>")
    return (
        events.join(packs, "event_id", "left")
        .withColumn("evidence", shown)
        .select(
            F.col("event_id").alias("execution_id"), "evidence", "label", "vec_id",
            F.concat(F.lit("hash"), key.cast("string")).alias("fact_record_hash"),
            F.concat(F.lit("A"), key.cast("string")).alias("asset_id"), "document_version_hash",
            F.col("contract_id").alias("event_contract_id"), variance.alias("event_variance_usd"),
            F.when(label == 3, "src99").otherwise(F.col("contract_id")).alias("contract_id"),
            F.when(label == 4, variance + 1.0).otherwise(variance + 0.005).alias("audited_variance_usd"),
            (key % 2 == 0).alias("dispute_warranted"),
            F.when(label == 5, none).when(label == 6, F.array(key, F.lit(999999).cast("bigint")))
            .otherwise(F.array(key)).alias("supporting_chunk_ids"),
            F.lit("The contract covers it.").alias("compliance_justification_rationale"),
            F.when(label == 9, "Urgent").otherwise("Medium").alias("recommended_case_priority"),
            F.when(label != 1, F.concat(F.lit("Case "), key.cast("string"))).alias("salesforce_case_subject"),
            F.lit("Body").alias("salesforce_case_description"),
        )
    )


part("verdicts", """
SELECT 'E' || vec_id AS execution_id, vec_id, label, vec_id * 20.0 AS variance, vec_id % 2 = 0 AS warranted, f.ids, f.n
FROM embeddings LEFT JOIN (SELECT event_id, string_agg(chunk_id, ', ' ORDER BY rank) AS ids, count(*) AS n FROM found GROUP BY 1) f
  ON f.event_id = 'E' || vec_id
""", ["found"])

part("guarded", """
SELECT *, failures = '' AS passed FROM (SELECT *, CASE
  WHEN label = 7 THEN concat_ws(';', 'No evidence chunks were retrieved.', 'Best evidence similarity 0.000 is below threshold 0.620.',
    'Verdict cites chunks not present in retrieved evidence: [' || vec_id || ']')
  WHEN label = 8 THEN 'Retrieved chunks from wrong contract: [' || ids || ']'
  WHEN label = 2 THEN 'Best evidence similarity 0.500 is below threshold 0.620.'
  WHEN label = 3 THEN 'Verdict contract_id does not match breach event contract_id.'
  WHEN label = 4 THEN 'Verdict variance does not match Gold fact variance.'
  WHEN label = 5 AND warranted THEN 'Dispute is warranted but no supporting chunk IDs were provided.'
  WHEN label = 6 THEN 'Verdict cites chunks not present in retrieved evidence: [999999]' ELSE '' END AS failures FROM verdicts)
""", ["verdicts"])


@query("verdict_guard", "SELECT execution_id, passed AS guardrail_passed, failures FROM guarded", ["guarded"])
def verdict_guard(spark, sf_dir):
    return ops.guard(verdict_cases(spark, sf_dir)).select(
        "execution_id", "guardrail_passed", F.array_join("guardrail_failures", ";").alias("failures")
    )


@query("best_similarity", """
SELECT 'E' || vec_id AS event_id, CASE WHEN label = 7 THEN 0.0 ELSE 1.0 END AS best_similarity FROM embeddings
""".replace("0.0 ELSE 1.0 END", "CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"))
def best_similarity(spark, sf_dir):
    """Best similarity per event; 0 without evidence."""
    asked = t.vector_events(spark, sf_dir).withColumn("document_version_hash", F.when(F.col("label") == 7, "gone"))
    found = retrieval.retrieve(asked, t.vector_chunks(spark, sf_dir))
    best = found.groupBy("event_id").agg(F.max("similarity").alias("best"))
    return asked.join(best, "event_id", "left").select("event_id", F.coalesce("best", F.lit(0.0)).alias("best_similarity"))


@query("location_guard", """
SELECT execution_id, concat_ws(';',
  CASE WHEN label = 3 THEN 'Verdict contract_id does not match payload associated_ppa_id.' END,
  CASE WHEN label = 4 AND warranted THEN 'Verdict variance does not match deterministic Gold fact variance.' END,
  CASE WHEN label = 7 AND warranted THEN 'No retrieved contract evidence was available.' END,
  CASE WHEN label = 6 THEN 'Evidence reference (1, -1) was not retrieved from the contract store.'
       WHEN label = 7 THEN 'Evidence reference (1, ' || vec_id || ') was not retrieved from the contract store.' END) AS failures
FROM verdicts
""", ["verdicts"])
def location_guard(spark, sf_dir):
    rows = verdict_cases(spark, sf_dir)
    place = F.when(F.col("label") == 6, -1).otherwise(F.col("vec_id")).cast("int")
    rows = rows.withColumns({
        "dispute_required": F.col("dispute_warranted"),
        "variance_confirmed_usd": F.when(F.col("label") == 4, F.col("event_variance_usd") + 1).otherwise(F.col("event_variance_usd")),
        "cited": F.array(F.struct(F.lit(1).alias("page_number"), place.alias("chunk_index"))),
    })
    return ops.guard_by_location(rows).select("execution_id", F.array_join("guardrail_failures", ";").alias("failures"))


@query("enforced_verdicts", """
SELECT execution_id, CAST(variance AS DOUBLE) AS audited_variance_usd, 'src' || label AS contract_id FROM verdicts
""", ["verdicts"])
def enforced_verdicts(spark, sf_dir):
    return ops.enforce_gold(verdict_cases(spark, sf_dir)).select("execution_id", "audited_variance_usd", "contract_id")


@query("verdict_schema", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'not a JSON object'
  ELSE 'missing field: salesforce_case_description;unexpected field: note;invalid priority: ' || o_orderpriority END AS problems FROM orders
""")
def verdict_schema(spark, sf_dir):
    """Whole verdicts, cut ones and ones with a wrong field, by order status."""
    head = F.concat(
        F.lit('{"dispute_warranted": true, "audited_variance_usd": '), float_text("o_totalprice"),
        F.lit(', "contract_id": "c", "supporting_chunk_ids": [1], "compliance_justification_rationale": "r", "salesforce_case_subject": "s"'),
    )
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(head, F.lit(', "salesforce_case_description": "d", "recommended_case_priority": "Low"}')))
        .when(F.col("o_orderstatus") == "P", F.lit("{broken"))
        .otherwise(F.concat(head, F.lit(', "note": 1, "recommended_case_priority": "'), "o_orderpriority", F.lit('"}')))
    )
    return t.read(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(ops.validate_verdict(text), ";").alias("problems")
    )


def queue(spark, sf_dir):
    return ops.approval_queue(ops.guard(verdict_cases(spark, sf_dir)))


def decisions(spark, sf_dir):
    """Contracts 0, 1 and 9 were decided, twice; the others are still waiting."""
    base = t.read(spark, sf_dir, "embeddings").filter(F.col("label").isin(0, 1, 9)).select(
        F.concat(F.lit("APR-E"), F.col("vec_id").cast("string")).alias("approval_id"), "vec_id", "label"
    )
    first = base.withColumns({"approved": F.lit(True), "decided_at": F.lit("2024-02-01 08:00:00").cast("timestamp")})
    second = base.withColumns({"approved": F.col("label") != 0, "decided_at": F.lit("2024-02-02 08:00:00").cast("timestamp")})
    return first.unionByName(second).select(
        "approval_id", "approved", "decided_at",
        F.when(F.col("label") == 9, "Edited").otherwise("").alias("edited_case_subject"),
        F.lit(None).cast("string").alias("edited_case_description"),
    )


part("queued", "SELECT * FROM guarded WHERE passed AND warranted", ["guarded"])
part("decided", """
SELECT *, CASE WHEN label = 0 THEN 'REJECTED' WHEN label IN (1, 9) THEN 'APPROVED' ELSE 'PENDING' END AS approval_status,
  CASE WHEN label = 9 THEN 'Edited' WHEN label <> 1 THEN 'Case ' || vec_id END AS case_subject FROM queued
""", ["queued"])


@query("approval_queue", """
SELECT 'APR-' || execution_id AS approval_id, variance >= 5000 AS high_value_flag, CAST(variance AS DOUBLE) AS variance_usd,
  'PENDING' AS approval_status FROM queued
""", ["queued"])
def approval_queue(spark, sf_dir):
    return queue(spark, sf_dir).select("approval_id", "high_value_flag", "variance_usd", "approval_status")


@query("applied_decisions", "SELECT 'APR-' || execution_id AS approval_id, approval_status, case_subject FROM decided", ["decided"])
def applied_decisions(spark, sf_dir):
    return ops.apply_decisions(queue(spark, sf_dir), decisions(spark, sf_dir)).select(
        "approval_id", "approval_status", "case_subject"
    )


def worked_cases(spark, sf_dir):
    """Guarded cases with their approval and the outcome of the dispatch."""
    guarded = materialize(ops.guard(verdict_cases(spark, sf_dir)), "guarded")
    decided = ops.apply_decisions(ops.approval_queue(guarded), decisions(spark, sf_dir)).select(
        "execution_id", "approval_status", "case_subject", "case_description", "variance_usd", "recommended_priority"
    )
    sent = F.when(F.col("approval_status") == "APPROVED", F.col("vec_id") % 4 == 0)
    return guarded.join(decided, "execution_id", "left").withColumns({
        "dispatch_success": sent,
        "crm_case_id": F.when(sent, F.concat(F.lit("500"), F.col("vec_id").cast("string"))),
    })


part("worked", """
SELECT g.*, d.approval_status, CASE WHEN NOT g.passed THEN 'halted_or_quarantined' WHEN NOT g.warranted THEN 'no_dispute_warranted'
  WHEN d.approval_status = 'REJECTED' THEN 'halted_or_quarantined' WHEN d.approval_status = 'PENDING' THEN 'pending'
  WHEN g.vec_id % 4 = 0 THEN 'crm_case_created' ELSE 'crm_dispatch_failed' END AS terminal_status
FROM guarded g LEFT JOIN decided d USING (execution_id)
""", ["guarded", "decided"])


@query("terminal_statuses", "SELECT execution_id, terminal_status FROM worked", ["worked"])
def terminal_statuses(spark, sf_dir):
    return worked_cases(spark, sf_dir).select("execution_id", ops.terminal_status().alias("terminal_status"))


@query("crm_outbox", """
SELECT execution_id, coalesce(case_subject, 'PPA Settlement Dispute: A' || vec_id) AS subject,
  CASE WHEN label = 9 THEN 'High' ELSE 'Medium' END AS priority,
  'Body' || chr(10) || chr(10) || 'Revenue assurance audit metadata:' || chr(10) || '{' || chr(10) || '  "asset_id": "A' || vec_id || '",' || chr(10)
  || '  "contract_id": "src' || label || '",' || chr(10) || '  "fact_record_hash": "hash' || vec_id || '",' || chr(10)
  || '  "dispute_value_usd": ' || CAST(CAST(variance AS DOUBLE) AS VARCHAR) || ',' || chr(10)
  || '  "evidence_chunk_ids": [' || chr(10) || '    ' || vec_id || chr(10) || '  ]' || chr(10) || '}' AS description
FROM decided WHERE approval_status = 'APPROVED'
""", ["decided"])
def crm_outbox(spark, sf_dir):
    return ops.crm_outbox(worked_cases(spark, sf_dir)).select(
        "execution_id", F.col("Subject").alias("subject"), F.col("Priority").alias("priority"),
        F.col("Description").alias("description"),
    )


@query("mock_actions", """
SELECT execution_id, CASE label WHEN 9 THEN 'MOCK_UPDATE_SALESFORCE_DISPUTE' ELSE 'MOCK_CREATE_SALESFORCE_DISPUTE' END AS mock_action_type
FROM decided WHERE approval_status = 'APPROVED'
""", ["decided"])
def mock_actions(spark, sf_dir):
    action = F.when(F.col("label") == 9, "UPDATE_EXISTING_SALESFORCE_DISPUTE").otherwise("READY_FOR_HUMAN_REVIEW")
    rows = worked_cases(spark, sf_dir).withColumn("recommended_next_action", action)
    return ops.mock_actions(rows).select("execution_id", "mock_action_type")


@query("audit_log", """
SELECT execution_id, 'src' || label AS contract_id, CASE WHEN label = 7 THEN '' ELSE replace(ids, ' ', '') END AS chunk_ids,
  coalesce(approval_status = 'APPROVED', FALSE) AS human_authorized_release, terminal_status FROM worked
""", ["worked"])
def audit_log(spark, sf_dir):
    rows = worked_cases(spark, sf_dir).withColumn("terminal_status", ops.terminal_status())
    log = ops.audit_log(rows, ["asset_id", "event_variance_usd"], ["contract_id", "dispute_warranted"])
    return log.select(
        "execution_id", "contract_id", F.array_join(F.col("retrieved_chunk_ids").cast("array<string>"), ",").alias("chunk_ids"),
        "human_authorized_release", "terminal_status",
    )


@query("dispatch_gate", """
SELECT execution_id, variance > 1000 AND label <> 7 AND passed AND coalesce(approval_status = 'APPROVED', FALSE) AS dispatch_allowed
FROM worked
""", ["worked"])
def dispatch_gate(spark, sf_dir):
    return worked_cases(spark, sf_dir).select("execution_id", ops.dispatch_allowed(1000.0).alias("dispatch_allowed"))


@query("retained_records", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 2000 DAY
""")
def retained_records(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").withColumn("created_at_timestamp", F.col("o_orderdate").cast("timestamp"))
    return ops.retain(rows, F.lit(AS_OF).cast("timestamp"), days=2000).select("o_orderkey")


@query("prompt_tokens", """
SELECT doc_id, greatest(1, length(text) // 4) AS headroom_tokens_before, length(text) // 4 >= 200 AS headroom_enabled,
  CASE WHEN length(text) // 4 >= 200 THEN greatest(1, length(trim(regexp_replace(text, '[aeiou]', '', 'g'))) // 4)
       ELSE greatest(1, length(text) // 4) END AS headroom_tokens_after FROM documents
""")
def prompt_tokens(spark, sf_dir):
    """Texts as prompts, compressed by leaving out plain vowels."""
    rows = t.read(spark, sf_dir, "documents").withColumn("short", F.trim(F.regexp_replace("text", "[aeiou]", "")))
    return ops.token_metrics(rows, "text", "short", threshold=200).select(
        "doc_id", "headroom_tokens_before", "headroom_enabled", "headroom_tokens_after"
    )


@query("conversation_tokens", """
SELECT conv_id, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY 1
""")
def conversation_tokens(spark, sf_dir):
    return t.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(rough_tokens("text")).alias("tokens"))
