"""Queries from breach events to routed cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import fixed_values as fv
from gridledger.functions.scalars import time_text
from gridledger.functions.skew import dealt
from gridledger.operators import cases as ops
from gridledger.operators import documents, enterprise
from gridledger.plans import tables as t
from gridledger.plans import documents as _document_parts  # noqa: F401  (chunks are built on them)
from gridledger.plans.registry import part, query
from gridledger.plans.settlement import _billing
from gridledger.session import materialize
from gridledger.sources import sinks

INSTRUCTION = "Explain the leakage case from the given facts and evidence only."
RUN_AT = "2024-02-01 00:00:00"

part("links", """
SELECT b.breach_event_id, d.document_id, d.document_type, CASE d.document_type WHEN 'ISO_CURTAILMENT_NOTICE' THEN 'OPERATIONAL_SUPPORT'
    ELSE 'SETTLEMENT_SUPPORT' END AS evidence_role, CASE d.document_type WHEN 'ISO_CURTAILMENT_NOTICE' THEN 2 ELSE 3 END AS role_rank,
  CASE d.document_type WHEN 'ISO_CURTAILMENT_NOTICE' THEN 80 ELSE 75 END AS score
FROM breaches b JOIN docs d ON d.contract_id = b.contract_id AND d.asset_id = b.asset_id AND d.event_date = b.market_date
WHERE d.document_type <> 'PPA'
UNION ALL
SELECT b.breach_event_id, max_by(d.document_id, (d.event_date, d.document_id)), 'PPA', 'CONTRACTUAL_SUPPORT', 1, 95
FROM breaches b JOIN docs d ON d.contract_id = b.contract_id AND d.event_date <= b.market_date
WHERE d.document_type = 'PPA' GROUP BY 1
""", ["breaches", "docs"])

part("evidence", """
SELECT * FROM (SELECT l.*, c.chunk_index, c.text_snippet,
  row_number() OVER (PARTITION BY breach_event_id ORDER BY role_rank, score DESC, document_id, chunk_index) AS context_rank
  FROM links l JOIN chunks c USING (document_id) WHERE c.text_snippet <> '') WHERE context_rank <= 8
""", ["links", "chunks"])

part("case_ready", """
SELECT b.breach_event_id, b.hour_utc, b.asset_id, b.equip_name AS asset_name, b.contract_id, b.oftaker_name AS offtaker_name,
  b.curtailment_reason, round(b.eligible_mwh, 2) AS eligible_mwh, round(b.leakage_usd, 2) AS leakage_usd, b.severity,
  x.b.invoice_id AS invoice_id, x.b.status AS invoice_status, CAST(x.b.open AS DOUBLE) AS open_amount_usd,
  x.b.doc AS accounting_doc_id, x.b.gl AS gl_account, x.b.pc AS profit_center, i.c.c AS sf_contract_id, i.c.a AS sf_account_id,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS account_name,
  d.dispute_number AS existing_dispute_number, d.dispute_number IS NOT NULL AS has_dispute,
  CASE WHEN b.contract_id IS NULL OR x.b.invoice_id IS NULL OR i.c.a IS NULL THEN 'REVIEW_DATA_GAPS'
       WHEN d.dispute_number IS NOT NULL THEN 'UPDATE_EXISTING_SALESFORCE_DISPUTE' ELSE 'READY_FOR_HUMAN_REVIEW' END AS action
FROM breaches b LEFT JOIN billed x USING (asset_id, contract_id, market_date)
LEFT JOIN in_force i USING (contract_id, asset_id, market_date) LEFT JOIN customer ON i.c.a = 'SF' || c_custkey
LEFT JOIN open_disputes d USING (asset_id, contract_id, market_date)
""", ["breaches", "billed", "in_force", "open_disputes"])

part("packs", """
SELECT breach_event_id, count(*) AS n, bool_or(document_type = 'PPA') AS ppa, bool_or(document_type = 'ISO_CURTAILMENT_NOTICE') AS notice,
  bool_or(document_type = 'ISO_SETTLEMENT_STATEMENT') AS statement,
  list_sort(list(DISTINCT document_type)) AS kinds FROM evidence GROUP BY 1
""", ["evidence"])

part("answers", """
SELECT c.*, p.n, p.kinds, 'Revenue assurance identified a revenue leakage event for asset ' || asset_id || ' under contract ' || contract_id
  || ' with ' || offtaker_name || '.' || chr(10) || chr(10)
  || 'The Gold case fact estimates leakage of $' || leakage_usd || ' and eligible compensable energy of ' || eligible_mwh
  || ' MWh. This explanation does not recalculate that amount; it relies on the curated Gold calculation.' || chr(10) || chr(10)
  || 'Contractual support is ' || CASE WHEN ppa THEN '' ELSE 'not ' END || 'available from the linked PPA evidence. Operational support is '
  || CASE WHEN notice THEN '' ELSE 'not ' END || 'available from the ISO curtailment notice evidence. Settlement support is '
  || CASE WHEN statement THEN '' ELSE 'not ' END || 'available from the ISO settlement statement evidence.' || chr(10) || chr(10)
  || 'SAP context shows invoice ' || coalesce(invoice_id, 'None') || ' with invoice status ' || coalesce(invoice_status, 'None')
  || ', open amount ' || coalesce(CAST(open_amount_usd AS VARCHAR), 'None') || ', accounting document ' || coalesce(accounting_doc_id, 'None')
  || ', and GL account ' || coalesce(gl_account, 'None') || '. This provides finance and revenue-recognition context for the leakage case.'
  || chr(10) || chr(10) || 'Salesforce context shows account ' || coalesce(account_name, 'None') || ', contract record '
  || coalesce(sf_contract_id, 'None') || ', and existing open dispute flag ' || CASE WHEN has_dispute THEN 'True' ELSE 'False' END
  || '. Existing dispute number is ' || coalesce(existing_dispute_number, 'None') || '.' || chr(10) || chr(10)
  || 'Recommended next action: ' || action
  || '. Salesforce create/update should not be automated yet because human approval is required.' AS answer
FROM case_ready c JOIN packs p USING (breach_event_id)
""", ["case_ready", "packs"])


def case_ready(spark, sf_dir, breaches):
    rows = enterprise.with_finance(breaches, *_billing(spark, sf_dir))
    rows = enterprise.with_commercial(
        rows, t.accounts(spark, sf_dir), t.crm_contracts(spark, sf_dir), t.crm_assets(spark, sf_dir)
    )
    rows = ops.recommend(enterprise.with_disputes(rows, t.disputes(spark, sf_dir)))
    return rows.withColumns({
        "estimated_leakage_revenue_usd": F.round("estimated_leakage_revenue_usd", 2),
        "eligible_compensable_mwh": F.round("eligible_compensable_mwh", 2),
        "open_amount_usd": F.col("open_amount_usd").cast("double"),
    })


def evidence(spark, sf_dir, breaches):
    """Only documents that support some breach are cut into chunks.

    Breaches of the same contract, asset and day have the same evidence. It is
    linked and ranked once per such day: a dated document is one link, however
    many breaches its day has.
    """
    days = materialize(ops.case_days(breaches), "case-days")
    links = materialize(ops.link_evidence(ops.distinct_days(days), t.documents(spark, sf_dir)), "links")
    texts = t.documents(spark, sf_dir).select("document_id", "raw_text_content")
    linked = texts.join(links.select("document_id").distinct(), "document_id", "left_semi")
    found = ops.collect_evidence(links, documents.build_chunks(documents.to_lines(dealt(linked)), ["document_id"]))
    return ops.evidence_of_days(days, found)


def packages(spark, sf_dir, gold):
    breaches = ops.breach_events(gold)
    ready = case_ready(spark, sf_dir, breaches)
    return materialize(ops.case_package(ready, evidence(spark, sf_dir, breaches), INSTRUCTION), "packages")


def all_packages(spark, sf_dir):
    return packages(spark, sf_dir, t.stored_gold(spark, sf_dir))


@query("breach_events", """
SELECT breach_event_id, fact_record_hash, strftime(hour_utc, '%Y-%m-%d %H:%M:%S') AS hour_utc, asset_id, contract_id,
  severity AS breach_severity, round(leakage_usd, 6) AS estimated_leakage_revenue_usd, FALSE AS salesforce_dispatch_allowed
FROM breaches
""", ["breaches"])
def breach_events(spark, sf_dir):
    return ops.breach_events(t.gold_fact(spark, sf_dir)).select(
        "breach_event_id", "fact_record_hash", time_text("reconciliation_hour_utc").alias("hour_utc"), "asset_id",
        "contract_id", "breach_severity", F.round("estimated_leakage_revenue_usd", 6).alias("estimated_leakage_revenue_usd"),
        "salesforce_dispatch_allowed",
    )


@query("evidence_links", """
SELECT breach_event_id, document_id, document_type, evidence_role, role_rank, score AS evidence_score FROM links
""", ["links"])
def evidence_links(spark, sf_dir):
    return ops.link_evidence(ops.breach_events(t.stored_gold(spark, sf_dir)), t.documents(spark, sf_dir))


@query("evidence_packs", """
SELECT breach_event_id, context_rank, document_id, evidence_role, chunk_index, md5(text_snippet) AS text_md5 FROM evidence
""", ["evidence"])
def evidence_packs(spark, sf_dir):
    found = evidence(spark, sf_dir, ops.breach_events(t.stored_gold(spark, sf_dir)))
    return found.select("breach_event_id", F.inline("evidence_context")).select(
        "breach_event_id", "context_rank", "document_id", "evidence_role", "chunk_index", F.md5("chunk_text").alias("text_md5")
    )


def _offered(spark, sf_dir):
    """Ratings of parts by order as ranked evidence, some unranked or unscored."""
    return t.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("B"), F.col("l_orderkey").cast("string")).alias("breach_event_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") - 1).alias("context_rank"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("int")).alias("evidence_score"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("document_id"), F.col("l_suppkey").alias("chunk_index"),
    )


@query("ranked_evidence", """
SELECT breach_event_id, document_id, chunk_index, position FROM (
  SELECT 'B' || l_orderkey AS breach_event_id, 'P' || l_partkey AS document_id, l_suppkey AS chunk_index,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY
      coalesce(nullif(CASE WHEN l_returnflag <> 'N' THEN l_linenumber - 1 END, 0), 999),
      coalesce(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INTEGER) END, 0) DESC, 'P' || l_partkey, l_suppkey) AS position
  FROM lineitem) WHERE position <= 8
""")
def ranked_evidence(spark, sf_dir):
    return ops.top_evidence(_offered(spark, sf_dir)).select("breach_event_id", "document_id", "chunk_index", "position")


@query("recommended_actions", "SELECT breach_event_id, action AS recommended_next_action FROM case_ready", ["case_ready"])
def recommended_actions(spark, sf_dir):
    ready = case_ready(spark, sf_dir, ops.breach_events(t.stored_gold(spark, sf_dir)))
    return ready.select("breach_event_id", "recommended_next_action")


@query("case_packages", """
SELECT c.breach_event_id, asset_name, severity AS breach_severity, invoice_id, invoice_status, open_amount_usd, accounting_doc_id,
  sf_contract_id, account_name, has_dispute AS existing_open_dispute_flag, existing_dispute_number, action AS recommended_next_action,
  coalesce(n, 0) AS evidence_count, array_to_string(kinds, ',') AS document_types
FROM case_ready c LEFT JOIN packs USING (breach_event_id)
""", ["case_ready", "packs"])
def case_packages(spark, sf_dir):
    kinds = F.array_join(ops.document_types(F.col("evidence_context")), ",")
    return all_packages(spark, sf_dir).select(
        "breach_event_id", "asset_name", "breach_severity", "invoice_id", "invoice_status", "open_amount_usd",
        "accounting_doc_id", "sf_contract_id", "account_name", "existing_open_dispute_flag", "existing_dispute_number",
        "recommended_next_action", F.size("evidence_context").alias("evidence_count"),
        F.nullif(kinds, F.lit("")).alias("document_types"),
    )


def _requested(gold):
    """Every fact is asked for; facts without leakage have no case."""
    return gold.select(
        F.sha2(F.concat(F.lit("BREACH|"), "fact_record_hash"), 256).alias("breach_event_id")
    )


@query("case_readiness", """
SELECT id AS requested_id, CASE WHEN errors = '' THEN 'READY' ELSE 'BLOCKED' END AS readiness_status, errors FROM (
  SELECT r.id, CASE WHEN c.breach_event_id IS NULL THEN 'Breach event ID not found: ' || r.id || ';Missing required field: breach_event_id'
      || ';Missing required field: asset_id;Missing required field: contract_id;Missing required field: estimated_leakage_revenue_usd'
      || ';Missing required field: recommended_next_action;No evidence_context was supplied.'
    WHEN p.n IS NULL THEN 'No evidence_context was supplied.' ELSE '' END AS errors
  FROM (SELECT DISTINCT sha256('BREACH|' || fact_record_hash) AS id FROM gold) r
  LEFT JOIN case_ready c ON c.breach_event_id = r.id LEFT JOIN packs p ON p.breach_event_id = r.id)
""", ["gold", "case_ready", "packs"])
def case_readiness(spark, sf_dir):
    gold = t.stored_gold(spark, sf_dir)
    return ops.validate_readiness(packages(spark, sf_dir, gold), _requested(gold)).select(
        "requested_id", "readiness_status", F.array_join("validation_errors", ";").alias("errors")
    )


@query("case_explanations", "SELECT breach_event_id, answer AS rag_answer FROM answers", ["answers"])
def case_explanations(spark, sf_dir):
    ready = all_packages(spark, sf_dir).filter(F.size("evidence_context") > 0)
    return ops.explain(ready).select("breach_event_id", "rag_answer")


_SQL_FACT = {
    "eligible_compensable_mwh": "CAST(eligible_mwh AS VARCHAR)", "estimated_leakage_revenue_usd": "CAST(leakage_usd AS VARCHAR)",
    "open_amount_usd": "CAST(open_amount_usd AS VARCHAR)", "breach_severity": "severity", "recommended_next_action": "action",
    "existing_open_dispute_flag": "CASE WHEN has_dispute THEN 'True' ELSE 'False' END",
}


def _prompt_sql() -> str:
    blocks = [f"'{INSTRUCTION}'"]
    for title, rows in fv.PROMPT_FACTS:
        lines = [f"'{label}: ' || coalesce({_SQL_FACT.get(name, name)}, 'None')" for label, name in rows]
        blocks.append(f"'{title}:' || chr(10) || " + " || chr(10) || ".join(lines))
    blocks.append("'Evidence:' || chr(10) || blocks")
    return " || chr(10) || chr(10) || ".join(blocks)


@query("case_prompts", f"""
SELECT breach_event_id, md5(trim({_prompt_sql()}, ' ')) AS prompt_md5, length({_prompt_sql()}) AS prompt_chars
FROM case_ready JOIN (
  SELECT breach_event_id, string_agg(chr(10) || 'Evidence Rank: ' || context_rank || chr(10) || 'Document Type: ' || document_type || chr(10)
    || 'Evidence Role: ' || evidence_role || chr(10) || 'Document ID: ' || document_id || chr(10) || 'Text:' || chr(10) || text_snippet || chr(10),
    chr(10) || '---' || chr(10) ORDER BY context_rank) AS blocks FROM evidence GROUP BY 1) USING (breach_event_id)
""", ["case_ready", "evidence"])
def case_prompts(spark, sf_dir):
    ready = all_packages(spark, sf_dir).filter(F.size("evidence_context") > 0)
    prompt = ready.select("breach_event_id", ops.case_prompt(INSTRUCTION).alias("prompt"))
    return prompt.select("breach_event_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


@query("grounding_errors", """
SELECT breach_event_id, CASE severity
    WHEN 'LOW' THEN concat_ws(';', 'Generated answer is empty.', 'Answer does not mention required grounded value: ' || asset_id,
      'Answer does not mention required grounded value: ' || contract_id, 'Answer does not mention required grounded value: ' || invoice_id,
      'Answer does not mention required grounded value: ' || sf_contract_id)
    WHEN 'MEDIUM' THEN 'Answer leaked prompt instruction text.' ELSE '' END AS errors
FROM answers
""", ["answers"])
def grounding_errors(spark, sf_dir):
    """Answers emptied or spoilt by severity, so that every check fires."""
    rows = ops.explain(ops.validate_readiness(all_packages(spark, sf_dir)).filter(F.col("readiness_status") == "READY"))
    spoilt = F.when(F.col("breach_severity") == "LOW", "").when(
        F.col("breach_severity") == "MEDIUM", F.concat("rag_answer", F.lit(" Do not recalculate."))
    ).otherwise(F.col("rag_answer"))
    return ops.validate_grounding(rows.withColumn("rag_answer", spoilt)).select(
        "breach_event_id", F.array_join("validation_errors", ";").alias("errors")
    )


part("routed", """
SELECT r.id AS requested_id, CASE WHEN a.breach_event_id IS NOT NULL THEN 'READY' ELSE 'BLOCKED' END AS readiness_status,
  CASE a.action WHEN 'READY_FOR_HUMAN_REVIEW' THEN 'HUMAN_REVIEW_QUEUE'
    WHEN 'UPDATE_EXISTING_SALESFORCE_DISPUTE' THEN 'HUMAN_REVIEW_EXISTING_DISPUTE_UPDATE'
    WHEN 'REVIEW_DATA_GAPS' THEN 'DATA_GAP_OR_THRESHOLD_REVIEW' END AS final_route, a.n, a.action
FROM (SELECT DISTINCT sha256('BREACH|' || fact_record_hash) AS id FROM gold) r LEFT JOIN answers a ON a.breach_event_id = r.id
""", ["gold", "answers"])


@query("routed_cases", """
SELECT requested_id, readiness_status, final_route, action AS recommended_next_action, FALSE AS approved_for_salesforce FROM routed
""", ["routed"])
def routed_cases(spark, sf_dir):
    gold = t.stored_gold(spark, sf_dir)
    rows = ops.run_cases(packages(spark, sf_dir, gold), _requested(gold), instructions=INSTRUCTION)
    return rows.select(
        "requested_id", "readiness_status", "final_route", "recommended_next_action", "approved_for_salesforce"
    )


@query("case_results", f"""
SELECT sha256(requested_id || '|{RUN_AT}') AS result_id, requested_id AS breach_event_id, final_route, coalesce(n, 0) AS evidence_used
FROM routed
""", ["routed"])
def case_results(spark, sf_dir):
    gold = t.stored_gold(spark, sf_dir)
    rows = ops.run_cases(packages(spark, sf_dir, gold), _requested(gold))
    results = ops.result_rows(rows, F.lit(RUN_AT).cast("timestamp"))
    used = F.coalesce(F.json_array_length("evidence_used_json"), F.lit(0))
    return results.select("result_id", "breach_event_id", "final_route", used.alias("evidence_used"))


@query("case_lookup", """
SELECT c.breach_event_id, coalesce(n, 0) AS evidence_count FROM case_ready c LEFT JOIN packs USING (breach_event_id)
WHERE severity = 'HIGH'
""", ["case_ready", "packs"])
def case_lookup(spark, sf_dir):
    rows = all_packages(spark, sf_dir)
    wanted = rows.filter(F.col("breach_severity") == "HIGH").select("breach_event_id")
    found = sinks.restore_evidence(sinks.get_cases(rows, wanted), rows.schema["evidence_context"].dataType)
    return found.select("breach_event_id", F.size("evidence_context").alias("evidence_count"))


@query("single_case", """
SELECT c.breach_event_id, coalesce(n, 0) AS evidence_count FROM case_ready c LEFT JOIN packs USING (breach_event_id)
ORDER BY c.breach_event_id LIMIT 1
""", ["case_ready", "packs"])
def single_case(spark, sf_dir):
    """The case with the smallest id, looked up by that id."""
    rows = all_packages(spark, sf_dir)
    first = rows.agg(F.min("breach_event_id")).first()[0] or ""
    found = sinks.restore_evidence(sinks.get_case(rows, first), rows.schema["evidence_context"].dataType)
    return found.select("breach_event_id", F.size("evidence_context").alias("evidence_count"))
