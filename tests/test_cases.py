import datetime as dt
import functools
import json

import pytest
from pyspark.sql import functions as F

from gridledger import fixed_values as fv
from gridledger.operators import cases, control_tower, enterprise, workflow
from gridledger.plans import cases as case_plans
from gridledger.plans import tables
from gridledger.profiles import CASE_SCHEMA, VERDICT_SCHEMA


def case(**changes):
    row = dict(
        breach_event_id="B1", asset_id="WIND_1", asset_name="North Wind", asset_type="WIND", contract_id="PPA-1",
        offtaker_name="Buyer LLC", curtailment_reason="CONGESTION", eligible_compensable_mwh=17.675,
        estimated_leakage_revenue_usd=751.19, breach_severity="HIGH", invoice_id="INV-1", invoice_status="PAID",
        open_amount_usd=0.0, accounting_doc_id="GL-1", gl_account="400100", profit_center="PC", sf_account_id="SF1",
        account_name="Buyer LLC", sf_contract_id="SFC1", existing_open_dispute_flag=False, existing_dispute_number=None,
        recommended_next_action="READY_FOR_HUMAN_REVIEW",
        evidence_context=[(1, "D1", "PPA", "CONTRACTUAL_SUPPORT", 95, 0, "clause"), (2, "D2", "ISO_CURTAILMENT_NOTICE", "OPERATIONAL_SUPPORT", 80, 0, "notice")],
    )
    row.update(changes)
    return tuple(row[n] for n in CASE_SCHEMA.names)


def run(spark, *rows, requested=None):
    packages = spark.createDataFrame(list(rows), CASE_SCHEMA)
    asked = spark.createDataFrame([(r,) for r in requested], "breach_event_id string") if requested else None
    return {r.requested_id: r for r in cases.run_cases(packages, asked, instructions="Use the facts.").collect()}


def test_ready_case_goes_to_review(spark):
    row = run(spark, case())["B1"]
    assert (row.readiness_status, row.final_route, row.approved_for_salesforce) == ("READY", "HUMAN_REVIEW_QUEUE", False)
    assert "for asset WIND_1 under contract PPA-1 with Buyer LLC." in row.rag_answer
    assert "estimates leakage of $751.19 and eligible compensable energy of 17.675 MWh" in row.rag_answer
    assert "Settlement support is not available" in row.rag_answer and "Operational support is available" in row.rag_answer
    assert "dispute flag False. Existing dispute number is None." in row.rag_answer
    assert row.prompt.startswith("Use the facts.\n\nCase Facts:\nBreach Event ID: B1\n") and "Evidence Rank: 2" in row.prompt


@pytest.mark.parametrize("action,route", [
    ("UPDATE_EXISTING_SALESFORCE_DISPUTE", "HUMAN_REVIEW_EXISTING_DISPUTE_UPDATE"), ("REVIEW_DATA_GAPS", "DATA_GAP_OR_THRESHOLD_REVIEW"),
    ("ANYTHING", "DATA_GAP_OR_THRESHOLD_REVIEW")])
def test_routes(spark, action, route):
    assert run(spark, case(recommended_next_action=action))["B1"].final_route == route


def test_blocked_cases_keep_all_messages_and_no_route(spark):
    rows = run(spark, case(contract_id="", recommended_next_action=None, evidence_context=[]), requested=["B1", "B2"])
    assert rows["B1"].validation_errors == [
        "Missing required field: contract_id", "Missing required field: recommended_next_action", "No evidence_context was supplied."]
    assert rows["B2"].validation_errors[0] == "Breach event ID not found: B2" and len(rows["B2"].validation_errors) == 7
    assert all(r.readiness_status == "BLOCKED" and r.final_route is None and r.rag_answer is None for r in rows.values())


def test_missing_invoice_is_no_grounding_error(spark):
    row = run(spark, case(invoice_id=None, sf_contract_id=None, existing_open_dispute_flag=None, open_amount_usd=None))["B1"]
    assert row.final_route == "HUMAN_REVIEW_QUEUE" and "invoice None with" in row.rag_answer and "flag None" in row.rag_answer


def test_evidence_order_and_limit(spark):
    entries = [(0, "zero", "PPA", "R", 1, 0, "t"), (None, "none", "PPA", "R", 50, 0, "t"), (2, "b", "PPA", "R", 10, 0, "t"),
               (2, "a", "PPA", "R", 90, 0, "t"), (1, "first", "PPA", "R", None, 0, "t")] + [(5, f"x{i}", "PPA", "R", 1, 0, "t") for i in range(6)]
    row = run(spark, case(evidence_context=entries))["B1"]
    assert [e.document_id for e in row.evidence_context] == ["first", "a", "b", "x0", "x1", "x2", "x3", "x4"]


def test_results_hold_nested_json(spark):
    packages = spark.createDataFrame([case()], CASE_SCHEMA)
    row = cases.result_rows(cases.run_cases(packages), F.lit("2026-06-24 00:00:00").cast("timestamp")).first()
    assert json.loads(row.validation_errors_json) == [] and len(json.loads(row.evidence_used_json)) == 2
    assert json.loads(row.case_package_json)["estimated_leakage_revenue_usd"] == 751.19


DOCS = "document_id string, document_type string, contract_id string, asset_id string, event_date date"


def test_links_use_the_contract_in_force_and_the_day(spark):
    breaches = spark.createDataFrame([("B1", "P", "W", dt.date(2026, 6, 23)), ("B2", "P", "S", dt.date(2026, 1, 1)), ("B3", "P", "W", dt.date(2025, 1, 1))],
                                     "breach_event_id string, contract_id string, asset_id string, market_date date")
    docs = spark.createDataFrame([
        ("PPA-old", "PPA", "P", "W", dt.date(2025, 6, 1)), ("PPA-new", "PPA", "P", "W", dt.date(2026, 2, 1)),
        ("N1", "ISO_CURTAILMENT_NOTICE", "P", "W", dt.date(2026, 6, 23)), ("N2", "ISO_CURTAILMENT_NOTICE", "P", "W", dt.date(2026, 6, 24)),
        ("S1", "ISO_SETTLEMENT_STATEMENT", "P", "W", dt.date(2026, 6, 23)), ("X", "OTHER", "P", "W", dt.date(2026, 6, 23))], DOCS)
    links = cases.link_evidence(breaches, docs)
    got = sorted((r.breach_event_id, r.document_id, r.evidence_role) for r in links.collect())
    assert got == [("B1", "N1", "OPERATIONAL_SUPPORT"), ("B1", "PPA-new", "CONTRACTUAL_SUPPORT"), ("B1", "S1", "SETTLEMENT_SUPPORT"),
                   ("B2", "PPA-old", "CONTRACTUAL_SUPPORT")]
    chunks = spark.createDataFrame([(d, i, f"{d}{i}") for d in ("PPA-new", "N1", "S1") for i in range(12)], "document_id string, chunk_index int, text_snippet string")
    pack = cases.collect_evidence(links, chunks, 8).filter("breach_event_id = 'B1'").first().evidence_context
    assert [e.chunk_text for e in pack] == [f"PPA-new{i}" for i in range(8)] and [e.context_rank for e in pack] == list(range(1, 9))


BREACHES = "breach_event_id string, contract_id string, asset_id string, market_date date"


def test_a_dated_document_is_linked_once_per_day_and_all_breaches_get_it(spark, tmp_path, monkeypatch):
    docs = [(420 * i + 3, f"notice {i}", "fr", "src3") for i in range(30)] + [(420 * i + 3, f"price {i}", "en", "src3") for i in (40, 41)]
    docs += [(420 * 50 + 3, None, "fr", "src3"), (7, "other", "en", "src7")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    day = tables.documents(spark, str(tmp_path)).filter("document_id = 'DOC3'").first()
    same = (day.contract_id, day.asset_id, day.event_date)
    rows = [(f"B{i}", *same) for i in range(20)]
    rows += [("twice", *same)] * 3 + [("both", *same), ("both", "src7", "A7", dt.date(2024, 1, 20))]
    rows += [("no asset", "src3", None, day.event_date), ("no contract", None, "A3", day.event_date), ("early", "src7", "A7", dt.date(2023, 1, 1))]
    breaches = spark.createDataFrame(rows, BREACHES)
    links, write = [], case_plans.materialize
    monkeypatch.setattr(case_plans, "materialize", lambda df, name: (links.append(df.count()) if name == "links" else None) or write(df, name))
    got = {r.breach_event_id: r.evidence_context for r in case_plans.evidence(spark, str(tmp_path), breaches).collect()}

    texts = tables.documents(spark, str(tmp_path)).select("document_id", "raw_text_content")
    chunks = case_plans.documents.build_chunks(case_plans.documents.to_lines(texts), ["document_id"])
    plain = cases.collect_evidence(cases.link_evidence(breaches, tables.documents(spark, str(tmp_path))), chunks)
    assert got == {r.breach_event_id: r.evidence_context for r in plain.collect()}
    assert len(got["B0"]) == 8 and [e.chunk_text for e in got["twice"]] != [e.chunk_text for e in got["B0"]] and len(got) == 23
    # 31 notices and a contract version for a day, for the day of three rows, and for the two days of one breach.
    assert links == [32 + 3 * 32 + 33 + 1]


@pytest.mark.parametrize("few", [0, 100])
def test_contracts_are_read_for_their_own_joins_only(spark, tmp_path, monkeypatch, few):
    """Also where accounts and assets are too many to broadcast: a second split join does not repeat the first."""
    facts = spark.createDataFrame(
        [("F1", "A1", "C1", dt.date(2024, 1, 5)), ("F2", "A1", None, dt.date(2024, 1, 5)), ("F3", "A2", "C2", dt.date(2024, 1, 5)),
         ("F4", None, "C1", None)], "fact string, asset_id string, contract_id string, market_date date")
    spark.createDataFrame(
        [("S1", "C1", "SF1", "A1", "one", "Activated", dt.date(2024, 1, 1), None), ("S2", "C2", "SF2", "A2", "two", "Draft", dt.date(2024, 1, 1), None)],
        "sf_contract_id string, contract_id string, sf_account_id string, asset_id string, contract_name string, contract_status string, "
        "start_date date, end_date date").write.parquet(f"{tmp_path}/contracts")
    contracts = spark.read.parquet(f"{tmp_path}/contracts")
    accounts = spark.createDataFrame([("SF1", "Buyer", "Active", "High"), ("SF1", "Buyer twice", "Active", "High")],
                                     "sf_account_id string, account_name string, account_status string, risk_tier string")
    assets = spark.createDataFrame([("SFA1", "A1"), ("SFA0", "A1")], "sf_asset_id string, asset_id string")
    monkeypatch.setattr(enterprise, "lookup_join", functools.partial(enterprise.lookup_join, max_rows=few))
    found = enterprise.with_commercial(facts, accounts, contracts, assets)
    got = sorted((r.fact, r.sf_contract_id or "", r.account_name or "", r.sf_asset_id or "") for r in found.collect())
    assert got == [("F1", "S1", "Buyer", "SFA0"), ("F1", "S1", "Buyer twice", "SFA0"), ("F2", "", "", "SFA0"), ("F3", "", "", ""), ("F4", "", "", "")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("contract_status#") and sum("Relation [" in line and "contract_status#" in line for line in plan.splitlines()) <= 3


def test_required_fields_are_the_fixed_five():
    assert len(fv.REQUIRED_CASE_FIELDS) == 5


# --- workflow ----------------------------------------------------------------------------

EVIDENCE = "array<struct<chunk_id:bigint,contract_id:string,page_number:int,chunk_index:int,similarity:double>>"
VERDICT = ("execution_id string, event_contract_id string, event_variance_usd double, contract_id string, audited_variance_usd double, "
           f"dispute_warranted boolean, supporting_chunk_ids array<bigint>, evidence {EVIDENCE}")
GOOD = ("X", "C", 100.0, "C", 100.005, True, [2, 1], [(1, "C", 1, 0, 0.9), (2, "C", 1, 1, 0.5)])


def failures(spark, row, **options):
    return workflow.guard(spark.createDataFrame([row], VERDICT), **options).first().guardrail_failures


def test_guard_passes_and_fails_in_order(spark):
    assert failures(spark, GOOD) == []
    assert failures(spark, GOOD, min_similarity=0.95) == ["Best evidence similarity 0.900 is below threshold 0.950."]
    bad = ("X", "C", None, "D", 5.0, True, None, None)
    assert failures(spark, bad) == [
        "No evidence chunks were retrieved.", "Best evidence similarity 0.000 is below threshold 0.620.",
        "Verdict contract_id does not match breach event contract_id.", "Verdict variance does not match Gold fact variance.",
        "Dispute is warranted but no supporting chunk IDs were provided."]
    mixed = GOOD[:6] + ([9, 7, 1],) + ([(1, "C", 1, 0, None), (4, "Z", 1, 1, 0.7)],)
    assert failures(spark, mixed) == ["Retrieved chunks from wrong contract: [4]", "Verdict cites chunks not present in retrieved evidence: [7, 9]"]


def test_verdict_schema(spark):
    good = json.dumps(dict(zip(fv.VERDICT_FIELDS, [True, 1.5, "C", [1], "r", "Low", "s", "d"])))
    texts = [good, "{cut", json.dumps({"contract_id": "C", "extra": 1}), None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r[0] for r in rows.select(workflow.validate_verdict(F.col("t"))).collect()]
    assert out[0] == [] and out[1] == ["not a JSON object"] and out[3] == ["not a JSON object"]
    assert len(out[2]) == 8 and out[2][-1] == "unexpected field: extra"
    parsed = rows.limit(1).select(workflow.parse_verdict(F.col("t")).alias("v")).first().v
    assert parsed.supporting_chunk_ids == [1] and VERDICT_SCHEMA.names == list(fv.VERDICT_FIELDS)


def test_terminal_states(spark):
    rows = spark.createDataFrame(
        [(False, True, None, None), (True, False, None, None), (True, True, None, None), (True, True, "PENDING", None),
         (True, True, "REJECTED", None), (True, True, "APPROVED", True), (True, True, "APPROVED", False), (True, None, None, None)],
        "guardrail_passed boolean, dispute_warranted boolean, approval_status string, dispatch_success boolean")
    assert [r[0] for r in rows.select(workflow.terminal_status()).collect()] == [
        "halted_or_quarantined", "no_dispute_warranted", "blocked_missing_human_approval", "pending", "halted_or_quarantined",
        "crm_case_created", "crm_dispatch_failed", "no_dispute_warranted"]


def test_outbox_defaults_and_json(spark):
    rows = spark.createDataFrame(
        [("X", "APPROVED", None, "", 'Say "why"', "Urgent", "W", "C", None, 12345678.0, []),
         ("Y", "PENDING", "S", "D", "r", "Low", "W", "C", "h", 1.0, [1]), ("Z", "APPROVED", "S", "D", "r", "Low", "W", 'C"1', "h", 1.5, [1, 2])],
        "execution_id string, approval_status string, case_subject string, case_description string, compliance_justification_rationale string, "
        "recommended_priority string, asset_id string, contract_id string, fact_record_hash string, variance_usd double, supporting_chunk_ids array<bigint>")
    out = {r.execution_id: r for r in workflow.crm_outbox(rows, "Desk").collect()}
    assert set(out) == {"X", "Z"}
    assert out["X"].Subject == "PPA Settlement Dispute: W" and out["X"].Priority == "High" and out["X"].Origin == "Desk Platform"
    head, tail = out["X"].Description.split("\n\nDesk audit metadata:\n")
    assert head == 'Say "why"'
    assert tail == json.dumps(dict(asset_id="W", contract_id="C", fact_record_hash=None, dispute_value_usd=12345678.0, evidence_chunk_ids=[]), indent=2)
    assert json.loads(out["Z"].Description.split("metadata:\n")[1])["evidence_chunk_ids"] == [1, 2]


def test_newest_decision_and_edits(spark):
    queue = spark.createDataFrame([("A1", "s", "d", "PENDING"), ("A2", "s", "d", "PENDING")], "approval_id string, case_subject string, case_description string, approval_status string")
    at = dt.datetime(2026, 1, 1)
    decisions = spark.createDataFrame(
        [("A1", False, "", None, at), ("A1", True, "new", "", at + dt.timedelta(hours=1))],
        "approval_id string, approved boolean, edited_case_subject string, edited_case_description string, decided_at timestamp")
    out = {r.approval_id: r for r in workflow.apply_decisions(queue, decisions).collect()}
    assert (out["A1"].approval_status, out["A1"].case_subject, out["A1"].case_description) == ("APPROVED", "new", "d")
    assert out["A2"].approval_status == "PENDING"


def test_token_metrics(spark):
    rows = spark.createDataFrame([("x" * 16000, "x" * 4000), ("x" * 15999, "x"), ("", None), ("x" * 16000, None)], "p string, c string")
    out = [(r.headroom_enabled, r.headroom_tokens_before, r.headroom_tokens_after, r.headroom_tokens_saved)
           for r in workflow.token_metrics(rows, "p", "c").collect()]
    assert out == [(True, 4000, 1000, 3000), (False, 3999, 3999, 0), (False, 1, 1, 0), (False, 4000, 4000, 0)]


# --- KPIs ------------------------------------------------------------------------------

def test_latency_percentile_interpolates(spark):
    rows = spark.createDataFrame([(v,) for v in [10, 10, 20, 30, None]], "ms int")
    row = control_tower.latency_stats(rows, "ms").first()
    assert (row.samples, row.avg_latency_ms) == (4, 17.5) and row.p95_latency_ms == pytest.approx(28.5)


def test_price_periods_are_half_open_and_may_be_open_ended(spark):
    models = spark.createDataFrame(
        [("m", 1.0, 2.0, 0.5, dt.date(2026, 1, 1), dt.date(2026, 2, 1)), ("m", 3.0, 4.0, 0.5, dt.date(2026, 2, 1), None)],
        "model_name string, input_price_per_1k_tokens double, output_price_per_1k_tokens double, embedding_price_per_1k_tokens double, "
        "effective_start_date date, effective_end_date date")
    usage = spark.createDataFrame(
        [("m", dt.datetime(2026, 1, 31, 23), 1000, 1000, 0), ("m", dt.datetime(2026, 2, 1), 1000, 0, 1000), ("none", dt.datetime(2026, 2, 1), 5, 5, 5)],
        "model_name string, created_at timestamp, prompt_tokens long, completion_tokens long, headroom_tokens_saved long")
    out = {(r.model_name, r.usage_date.month): (r.cost_usd, r.cost_saved_usd) for r in control_tower.price_usage(usage, models).collect()}
    assert out == {("m", 1): (3.0, 0.0), ("m", 2): (3.0, 3.0), ("none", 2): (0.0, 0.0)}


def test_summary_is_one_document(spark):
    one = spark.range(1).select(F.lit(1).alias("a"))
    row = control_tower.summary_document(one, one.toDF("b"), one.toDF("c")).first()
    assert json.loads(row.summary_json) == {"executive_overview": {"a": 1}, "rag_quality": {"b": 1}, "llm_finops": {"c": 1}}


def test_event_times_with_zone_and_fraction(spark):
    from gridledger.operators import control_tower

    times = ["2026-06-01T10:00:00+02:00", "2026-06-01T10:00:00.5Z", "2026-06-01 10:00:00", "10 o'clock", None]
    rows = spark.createDataFrame(
        [(str(i), x, {}, {}) for i, x in enumerate(times)], "event_id string, created_at_utc string, metrics map<string,string>, attributes map<string,string>")
    for name in ("event_type", "node_name", "component_name", "status", "trace_id", "rag_run_id"):
        rows = rows.selectExpr("*", f"cast(NULL AS string) AS {name}")
    got = {r.event_id: r for r in control_tower.normalise_events(rows).selectExpr("event_id", "string(created_at) AS at", "time_unparsed").collect()}
    assert [got[str(i)].at for i in range(5)] == ["2026-06-01 08:00:00", "2026-06-01 10:00:00.5", "2026-06-01 10:00:00", None, None]
    assert [got[str(i)].time_unparsed for i in range(5)] == [False, False, False, True, False]


def test_json_text_escapes_control_characters(spark):
    import json

    from gridledger.functions.scalars import json_text
    from pyspark.sql import functions as F

    texts = ['a"b\\c', "line\r\n\t\x01\x1f", "é漢", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_text(F.col("t")).alias("j")).collect()
    assert [json.loads(r.j) for r in got] == texts


def test_null_names_are_not_missing(spark):
    from gridledger.operators import enterprise

    partners = spark.createDataFrame([("1", "a", "N"), ("2", "b", None), ("3", "c", None)], "sap_customer_number string, sf_account_id string, business_partner_name string")
    accounts = spark.createDataFrame([("1", "a", None), ("2", "b", None), ("4", "d", None)], "sap_customer_number string, sf_account_id string, account_name string")
    got = {r.sf_account_id: r.match_status for r in enterprise.match_customers(partners, accounts).collect()}
    assert got == {"a": "NAME_MISMATCH", "b": "MATCHED", "c": "MISSING_IN_CRM", "d": "MISSING_IN_ERP"}


def test_vectors_that_are_null_or_of_another_length():
    import numpy as np
    import pyarrow as pa
    import pytest

    from gridledger.operators import retrieval

    vectors = pa.chunked_array([pa.array([[1.0, 2.0, 3.0, 4.0], None, [0.0, 0.0, 0.0, 0.0], [4.0, 3.0, 2.0, 1.0]])])
    assert np.array_equal(retrieval._matrix(vectors), [[1, 2, 3, 4], [0, 0, 0, 0], [0, 0, 0, 0], [4, 3, 2, 1]])
    with pytest.raises(ValueError):
        retrieval._matrix(pa.chunked_array([pa.array([[1.0, 2.0], [1.0]])]))
