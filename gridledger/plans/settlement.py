"""Queries on the leakage fact, statements and enterprise context."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gridledger.functions.scalars import time_text
from gridledger.operators import cases, energy, enterprise, gold, quality, silver
from gridledger.plans import tables as t
from gridledger.plans.registry import part, query
from gridledger.sources import merge

HOUR = "strftime(hour_utc, '%Y-%m-%d %H:%M:%S')"


def _r(name: str, digits: int = 6, alias: str | None = None):
    return F.round(name, digits).alias(alias or name)


def _hour(name: str = "reconciliation_hour_utc"):
    return time_text(name).alias("hour_utc")


@query("gold_leakage_fact", f"""
SELECT fact_record_hash, {HOUR} AS hour_utc, asset_id, equip_name, asset_type, iso_region, account_id, oftaker_name,
  associated_ppa_id, contract_rate_per_mwh, curtailment_compensable_flag, settlement_method, curtailment_event_id,
  curtailment_reason, sample_count, round(actual_mwh, 6) AS actual_generation_mwh,
  round(expected_mwh, 6) AS expected_available_mwh, round(limited_mwh, 6) AS grid_limited_mwh,
  round(physical_shortfall_mwh, 6) AS physical_shortfall_mwh, round(grid_curtailment_mwh, 6) AS grid_curtailment_mwh,
  round(eligible_mwh, 6) AS eligible_compensable_mwh, round(expected_settlement_usd, 6) AS expected_settlement_usd,
  round(actual_settlement_usd, 6) AS actual_settlement_usd, round(leakage_usd, 6) AS estimated_leakage_revenue_usd
FROM gold
""", ["gold"])
def gold_leakage_fact(spark, sf_dir):
    return t.gold_fact(spark, sf_dir).select(
        "fact_record_hash", _hour(), "asset_id", "equip_name", "asset_type", "iso_region", "account_id", "oftaker_name",
        "associated_ppa_id", "contract_rate_per_mwh", "curtailment_compensable_flag", "settlement_method",
        "curtailment_event_id", "curtailment_reason", "sample_count", _r("actual_generation_mwh"),
        _r("expected_available_mwh"), _r("grid_limited_mwh"), _r("physical_shortfall_mwh"), _r("grid_curtailment_mwh"),
        _r("eligible_compensable_mwh"), _r("expected_settlement_usd"), _r("actual_settlement_usd"),
        _r("estimated_leakage_revenue_usd"),
    )


@query("gold_incremental_merge", """
SELECT fact_record_hash, sample_count, round(leakage_usd, 6) AS estimated_leakage_revenue_usd FROM gold
""", ["gold"])
def gold_incremental_merge(spark, sf_dir):
    """The fact up to the 24th, then the look-back window to the end, merged by hash: equal to one full run."""
    rows, dims = t.silver_rows(spark, sf_dir), t.gold_dims(spark, sf_dir)
    hour = "reconciliation_hour_utc"

    def facts_of(part_rows):
        return gold.build_gold(energy.hourly_energy(part_rows, t.SAMPLE_SECONDS), **dims)

    first = facts_of(rows.filter(F.col(hour) < F.lit(dt.datetime(2024, 1, 25))))
    later = facts_of(silver.incremental(rows, hour, dt.datetime(2024, 1, 31), hours=8 * 24))
    merged = merge.upsert(first, later, ["fact_record_hash"], [hour])
    return merged.select("fact_record_hash", "sample_count", _r("estimated_leakage_revenue_usd"))


@query("gated_breaches", """
SELECT sha256('BREACH|' || fact_record_hash) AS breach_event_id, 'PASSED' AS dq_gate_status FROM gold WHERE leakage_usd > 0
""", ["gold"])
def gated_breaches(spark, sf_dir):
    """Breaches leave only when the checks on the stored fact pass."""
    fact = t.stored_gold(spark, sf_dir)
    checks = [
        quality.row_count_positive(), quality.not_missing("fact_record_hash"), quality.unique("fact_record_hash"),
        quality.non_negative("estimated_leakage_revenue_usd"), quality.compensable_consistent(),
    ]
    status = quality.gate_status(quality.run_checks(fact, "gold", checks), "gold")
    return cases.breach_events(fact, status).select("breach_event_id", "dq_gate_status")


@query("extra_curtailments", f"""
SELECT asset_id, {HOUR} AS hour_utc, min(curtailment_event_id) AS kept_event_id, count(*) - 1 AS extra_events
FROM curtailment GROUP BY asset_id, hour_utc HAVING count(*) > 1
""", ["curtailment"])
def extra_curtailments(spark, sf_dir):
    return gold.extra_curtailments(gold.typed_hour(t.curtailment(spark, sf_dir))).select(
        "asset_id", _hour(), "kept_event_id", "extra_events"
    )


@query("reason_eligibility", """
SELECT g.fact_record_hash, coalesce(CASE g.curtailment_reason WHEN 'CONGESTION' THEN c_mktsegment <> 'HOUSEHOLD'
    WHEN 'TRANSMISSION_CONSTRAINT' THEN c_mktsegment <> 'BUILDING' ELSE c_mktsegment = 'FURNITURE' END, FALSE)
    AND g.curtailment_event_id IS NOT NULL AS is_compensable,
  round(CASE WHEN coalesce(CASE g.curtailment_reason WHEN 'CONGESTION' THEN c_mktsegment <> 'HOUSEHOLD'
    WHEN 'TRANSMISSION_CONSTRAINT' THEN c_mktsegment <> 'BUILDING' ELSE c_mktsegment = 'FURNITURE' END, FALSE)
    AND g.curtailment_event_id IS NOT NULL THEN grid_curtailment_mwh ELSE 0.0 END, 6) AS eligible_compensable_mwh
FROM gold g JOIN customer ON g.asset_id = 'A' || c_custkey
""", ["gold"])
def reason_eligibility(spark, sf_dir):
    flags = t.asset_contract_map(spark, sf_dir).drop("contract_id", "contract_rate_usd_per_mwh")
    facts = t.gold_fact(spark, sf_dir).join(flags, "asset_id")
    return gold.with_reason_eligibility(facts).select("fact_record_hash", "is_compensable", _r("eligible_compensable_mwh"))


@query("material_leakage", """
SELECT fact_record_hash, round(leakage_usd, 6) AS estimated_leakage_revenue_usd FROM gold
WHERE leakage_usd > 0 AND (leakage_usd >= 5000 OR leakage_usd >= 0.5 * expected_settlement_usd)
""", ["gold"])
def material_leakage(spark, sf_dir):
    return gold.material(t.gold_fact(spark, sf_dir), ratio=0.5).select("fact_record_hash", _r("estimated_leakage_revenue_usd"))


def _leakage_by(name: str, dim: str, out: str) -> None:
    @query(name, f"""
SELECT {dim} AS {out}, count(*) AS fact_rows, round(sum(grid_curtailment_mwh), 4) AS curtailment_mwh,
  round(sum(eligible_mwh), 4) AS eligible_mwh,
  round(sum(expected_settlement_usd - actual_settlement_usd), 4) AS settlement_variance_usd,
  round(sum(leakage_usd), 4) AS leakage_usd FROM gold GROUP BY 1
""", ["gold"])
    def run(spark, sf_dir):
        return gold.leakage_by(t.gold_fact(spark, sf_dir), dim).select(
            F.col(dim).alias(out), "fact_rows", _r("curtailment_mwh", 4), _r("eligible_mwh", 4),
            _r("settlement_variance_usd", 4), _r("leakage_usd", 4),
        )


_leakage_by("leakage_by_asset", "asset_id", "asset_id")
_leakage_by("leakage_by_region", "iso_region", "iso_region")
_leakage_by("leakage_by_offtaker", "oftaker_name", "offtaker_name")
_leakage_by("leakage_by_contract", "associated_ppa_id", "contract_id")


@query("leakage_cube", """
SELECT asset_id, iso_region, oftaker_name, CAST(grouping(asset_id, iso_region, oftaker_name) AS INTEGER) AS slice_id,
  count(*) AS fact_rows, round(sum(leakage_usd), 4) AS leakage_usd
FROM gold GROUP BY GROUPING SETS ((asset_id), (iso_region), (oftaker_name), ())
""", ["gold"])
def leakage_cube(spark, sf_dir):
    return gold.leakage_cube(t.gold_fact(spark, sf_dir)).withColumn("leakage_usd", F.round("leakage_usd", 4))


@query("top_assets_by_leakage", """
SELECT asset_id, round(sum(leakage_usd), 4) AS leakage_usd FROM gold GROUP BY 1
ORDER BY sum(leakage_usd) DESC, asset_id LIMIT 10
""", ["gold"])
def top_assets_by_leakage(spark, sf_dir):
    return gold.top_leakage(t.gold_fact(spark, sf_dir), "asset_id", 10).select("asset_id", _r("leakage_usd", 4))


@query("top_contracts_by_leakage", """
SELECT associated_ppa_id AS contract_id, round(sum(leakage_usd), 4) AS leakage_usd FROM gold GROUP BY 1
ORDER BY sum(leakage_usd) DESC, 1 LIMIT 5
""", ["gold"])
def top_contracts_by_leakage(spark, sf_dir):
    return gold.top_leakage(t.gold_fact(spark, sf_dir), "associated_ppa_id", 5).select(
        F.col("associated_ppa_id").alias("contract_id"), _r("leakage_usd", 4)
    )


@query("leakage_running", f"""
SELECT associated_ppa_id AS contract_id, {HOUR} AS hour_utc, asset_id,
  round(sum(leakage_usd) OVER (PARTITION BY associated_ppa_id ORDER BY hour_utc, asset_id ROWS UNBOUNDED PRECEDING), 4)
    AS running_leakage_usd,
  round(CASE WHEN sum(leakage_usd) OVER (PARTITION BY associated_ppa_id) <> 0
    THEN leakage_usd / sum(leakage_usd) OVER (PARTITION BY associated_ppa_id) END, 9) AS contract_share
FROM gold
""", ["gold"])
def leakage_running(spark, sf_dir):
    return gold.leakage_running(t.stored_gold(spark, sf_dir)).select(
        F.col("associated_ppa_id").alias("contract_id"), _hour(), "asset_id", _r("running_leakage_usd", 4),
        _r("contract_share", 9),
    )


@query("run_summary", """
SELECT count(*) AS fact_rows, count(DISTINCT asset_id) AS asset_count, count(DISTINCT associated_ppa_id) AS contract_count,
  strftime(min(hour_utc), '%Y-%m-%d %H:%M:%S') AS first_hour, strftime(max(hour_utc), '%Y-%m-%d %H:%M:%S') AS last_hour,
  round(sum(leakage_usd), 4) AS leakage_usd FROM gold
""", ["gold"])
def run_summary(spark, sf_dir):
    return gold.run_summary(t.gold_fact(spark, sf_dir)).withColumns({
        "first_hour": time_text("first_hour"), "last_hour": time_text("last_hour"),
        "leakage_usd": F.round("leakage_usd", 4),
    })


@query("two_sided_settlement", """
SELECT fact_record_hash, round(actual_mwh * 30.0, 6) AS market_revenue_usd,
  round(actual_mwh * (contract_rate_per_mwh - 30.0), 6) AS contract_difference_usd,
  round(actual_mwh * 30.0 + actual_mwh * (contract_rate_per_mwh - 30.0), 6) AS total_revenue_usd,
  round(eligible_mwh * contract_rate_per_mwh, 6) AS potential_compensation_usd FROM gold
""", ["gold"])
def two_sided_settlement(spark, sf_dir):
    priced = t.gold_fact(spark, sf_dir).withColumn("market_price_usd_per_mwh", F.lit(30.0))
    return gold.two_sided_settlement(priced).select(
        "fact_record_hash", _r("market_revenue_usd"), _r("contract_difference_usd"), _r("total_revenue_usd"),
        _r("potential_compensation_usd"),
    )


@query("statement_reconciliation", """
SELECT asset_id, contract_id, strftime(market_date, '%Y-%m-%d') AS market_date, round(fact_usd, 4) AS fact_usd,
  round(statement_usd, 4) AS statement_usd,
  CASE WHEN fact_usd IS NULL THEN 'MISSING_IN_FACT' WHEN statement_usd IS NULL THEN 'MISSING_IN_STATEMENT'
       WHEN abs(fact_usd - statement_usd) > 0.01 THEN 'AMOUNT_MISMATCH' ELSE 'MATCHED' END AS reconciliation_status
FROM (SELECT asset_id, associated_ppa_id AS contract_id, CAST(hour_utc AS DATE) AS market_date, sum(leakage_usd) AS fact_usd
      FROM gold GROUP BY 1, 2, 3)
FULL JOIN (SELECT asset_id, contract_id, market_date, sum(usd) AS statement_usd FROM statements GROUP BY 1, 2, 3)
USING (asset_id, contract_id, market_date)
""", ["gold", "statements"])
def statement_reconciliation(spark, sf_dir):
    return gold.reconcile_statements(t.gold_fact(spark, sf_dir), t.statements(spark, sf_dir)).select(
        "asset_id", "contract_id", F.date_format("market_date", "yyyy-MM-dd").alias("market_date"),
        _r("fact_usd", 4), _r("statement_usd", 4), "reconciliation_status",
    )


# --- enterprise context -----------------------------------------------------------

part("facts", """
SELECT *, associated_ppa_id AS contract_id, CAST(hour_utc AS DATE) AS market_date FROM gold
""", ["gold"])


def facts(spark, sf_dir, stored: bool = False):
    fact = t.stored_gold(spark, sf_dir) if stored else t.gold_fact(spark, sf_dir)
    return fact.withColumnRenamed("associated_ppa_id", "contract_id").withColumn(
        "market_date", F.to_date("reconciliation_hour_utc")
    )


def _billing(spark, sf_dir):
    headers = t.invoice_headers(spark, sf_dir)
    return headers, t.invoice_lines(spark, sf_dir), t.gl_postings(spark, sf_dir), enterprise.derive_ar(headers)


@query("receivables", """
SELECT 'AR-' || invoice_id AS open_item_id, status AS payment_status, CAST(paid AS DOUBLE) AS paid_amount_usd,
  CAST(open AS DOUBLE) AS open_amount_usd, CASE WHEN open = 0 THEN 'NORMAL' ELSE 'MONITOR' END AS collections_status,
  CASE WHEN open > 0 THEN greatest(date_diff('day', day0 + 33, DATE '2024-02-15'), 0) ELSE 0 END AS days_past_due
FROM headers
""", ["headers"])
def receivables(spark, sf_dir):
    items = enterprise.derive_ar(t.invoice_headers(spark, sf_dir))
    return enterprise.days_past_due(items, F.lit("2024-02-15").cast("date")).select(
        "open_item_id", "payment_status", F.col("paid_amount_usd").cast("double"),
        F.col("open_amount_usd").cast("double"), "collections_status", "days_past_due",
    )


@query("curated_invoices", """
SELECT invoice_id, strftime(day0, '%Y-%m-%d') AS invoice_period_start, CAST(gross AS DOUBLE) AS gross_amount_usd,
  CASE WHEN status = 'PAID' THEN TRUE WHEN status = 'OPEN' THEN FALSE END AS is_paid FROM headers
""", ["headers"])
def curated_invoices(spark, sf_dir):
    """The extract as delivered text, with blanks and odd marks, typed again."""
    from pyspark.sql import types as T

    text = t.invoice_headers(spark, sf_dir).select(
        F.concat(F.lit(" "), "invoice_id", F.lit(" ")).alias("invoice_id"),
        F.col("invoice_period_start").cast("string").alias("invoice_period_start"),
        F.col("gross_amount_usd").cast("string").alias("gross_amount_usd"),
        F.when(F.col("invoice_status") == "PAID", "True").when(F.col("invoice_status") == "OPEN", "N").otherwise("").alias("is_paid"),
    )
    schema = T.StructType([
        T.StructField("invoice_id", T.StringType()), T.StructField("invoice_period_start", T.DateType()),
        T.StructField("gross_amount_usd", T.DecimalType(18, 2)), T.StructField("is_paid", T.BooleanType()),
    ])
    return enterprise.curate_enterprise(text, schema).select(
        "invoice_id", F.date_format("invoice_period_start", "yyyy-MM-dd").alias("invoice_period_start"),
        F.col("gross_amount_usd").cast("double"), "is_paid",
    )


@query("facts_with_finance", """
SELECT f.fact_record_hash, b.b.invoice_id AS invoice_id, b.b.status AS invoice_status, CAST(b.b.mwh AS DOUBLE) AS billed_mwh,
  CAST(b.b.usd AS DOUBLE) AS billed_usd, b.b.doc AS accounting_doc_id, b.b.gl AS gl_account, b.b.pc AS profit_center,
  CAST(b.b.open AS DOUBLE) AS open_amount_usd
FROM facts f LEFT JOIN billed b USING (asset_id, contract_id, market_date)
""", ["facts", "billed"])
def facts_with_finance(spark, sf_dir):
    return enterprise.with_finance(facts(spark, sf_dir, stored=True), *_billing(spark, sf_dir)).select(
        "fact_record_hash", "invoice_id", "invoice_status", F.col("billed_mwh").cast("double"),
        F.col("billed_usd").cast("double"), "accounting_doc_id", "gl_account", "profit_center",
        F.col("open_amount_usd").cast("double"),
    )


part("in_force", """
SELECT f.contract_id, f.asset_id, f.market_date, max_by({'c': sf_contract_id, 'a': sf_account_id}, (start_date, sf_contract_id)) AS c
FROM (SELECT DISTINCT contract_id, asset_id, market_date FROM facts) f JOIN crm_contracts c
  ON f.contract_id = c.contract_id AND f.asset_id = c.asset_id AND contract_status = 'Activated'
 AND market_date >= start_date AND (end_date IS NULL OR market_date <= end_date)
GROUP BY 1, 2, 3
""", ["facts", "crm_contracts"])


@query("facts_with_commercial", """
SELECT fact_record_hash, i.c.c AS sf_contract_id, i.c.a AS sf_account_id,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS account_name, 'SFA' || substr(f.asset_id, 2) AS sf_asset_id
FROM facts f LEFT JOIN in_force i USING (contract_id, asset_id, market_date)
LEFT JOIN customer ON i.c.a = 'SF' || c_custkey
""", ["facts", "in_force"])
def facts_with_commercial(spark, sf_dir):
    return enterprise.with_commercial(
        facts(spark, sf_dir, stored=True), t.accounts(spark, sf_dir), t.crm_contracts(spark, sf_dir), t.crm_assets(spark, sf_dir)
    ).select("fact_record_hash", "sf_contract_id", "sf_account_id", "account_name", "sf_asset_id")


@query("facts_with_disputes", """
SELECT fact_record_hash, d.dispute_number AS existing_dispute_number, d.dispute_number IS NOT NULL AS existing_open_dispute_flag,
  coalesce(d.n, 0) AS open_dispute_count
FROM facts LEFT JOIN open_disputes d USING (asset_id, contract_id, market_date)
""", ["facts", "open_disputes"])
def facts_with_disputes(spark, sf_dir):
    return enterprise.with_disputes(facts(spark, sf_dir), t.disputes(spark, sf_dir)).select(
        "fact_record_hash", "existing_dispute_number", "existing_open_dispute_flag", "open_dispute_count"
    )


@query("facts_without_dispute", """
SELECT fact_record_hash FROM facts f WHERE NOT EXISTS (SELECT 1 FROM open_disputes d
  WHERE d.asset_id = f.asset_id AND d.contract_id = f.contract_id AND d.market_date = f.market_date)
""", ["facts", "open_disputes"])
def facts_without_dispute(spark, sf_dir):
    return enterprise.new_cases_only(facts(spark, sf_dir), t.disputes(spark, sf_dir)).select("fact_record_hash")


@query("customer_match", """
SELECT 'CUST' || c_custkey AS sap_customer_number, 'SF' || c_custkey AS sf_account_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'MISSING_IN_CRM' WHEN c_acctbal < 0 THEN 'MISSING_IN_ERP'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'NAME_MISMATCH' ELSE 'MATCHED' END AS match_status
FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal >= 0
""")
def customer_match(spark, sf_dir):
    return enterprise.match_customers(t.partners(spark, sf_dir), t.accounts(spark, sf_dir)).select(
        "sap_customer_number", "sf_account_id", "match_status"
    )


@query("metering_variance", """
SELECT asset_id, strftime(billing_period, '%Y-%m-%d') AS billing_period, round(m.mwh, 4) AS metered_mwh,
  CAST(l.mwh AS DOUBLE) AS invoiced_mwh, round(m.mwh - coalesce(CAST(l.mwh AS DOUBLE), 0), 4) AS variance_mwh
FROM (SELECT asset_id, CAST(hour_utc AS DATE) AS billing_period, sum(actual_mwh) AS mwh FROM hourly GROUP BY 1, 2) m
LEFT JOIN (SELECT asset_id, billing_period, sum(qty) AS mwh FROM lines GROUP BY 1, 2) l USING (asset_id, billing_period)
""", ["hourly", "lines"])
def metering_variance(spark, sf_dir):
    metered = t.hourly(spark, sf_dir).withColumn("billing_period", F.to_date("reconciliation_hour_utc"))
    return enterprise.metering_variance(metered, t.invoice_lines(spark, sf_dir)).select(
        "asset_id", F.date_format("billing_period", "yyyy-MM-dd").alias("billing_period"), _r("metered_mwh", 4),
        F.col("invoiced_mwh").cast("double"), _r("variance_mwh", 4),
    )


@query("uninvoiced_facts", """
SELECT fact_record_hash, round(expected_settlement_usd, 6) AS expected_settlement_usd FROM facts f
WHERE expected_settlement_usd > 0 AND NOT EXISTS (SELECT 1 FROM billed b WHERE b.asset_id = f.asset_id
  AND b.contract_id = f.contract_id AND b.market_date = f.market_date)
""", ["facts", "billed"])
def uninvoiced_facts(spark, sf_dir):
    days = enterprise.billing_days(*_billing(spark, sf_dir))
    return enterprise.uninvoiced(facts(spark, sf_dir), days).select("fact_record_hash", _r("expected_settlement_usd"))


@query("finance_consistency", """
SELECT h.invoice_id, CAST(gross AS DOUBLE) AS gross_amount_usd, CAST(l.usd AS DOUBLE) AS lines_usd,
  CAST(posted AS DOUBLE) AS posted_usd, coalesce(l.off, 0) AS mispriced_lines,
  FALSE AS paid_open_differs, coalesce(abs(gross - l.usd) > 0.01, TRUE) AS lines_differ, abs(gross - posted) > 0.01 AS posting_differs
FROM headers h LEFT JOIN (SELECT invoice_id, sum(amount) AS usd, count(*) FILTER (WHERE abs(amount - qty * rate) > 0.01) AS off
  FROM lines GROUP BY 1) l USING (invoice_id)
""", ["headers", "lines"])
def finance_consistency(spark, sf_dir):
    return enterprise.finance_consistency(
        t.invoice_headers(spark, sf_dir), t.invoice_lines(spark, sf_dir), t.gl_postings(spark, sf_dir)
    ).withColumns({c: F.col(c).cast("double") for c in ("gross_amount_usd", "lines_usd", "posted_usd")})


@query("rate_agreement", """
SELECT c.contract_id, c.asset_id, CAST(c.rate AS DOUBLE) AS crm_rate, CAST(c.rate AS DOUBLE) AS map_rate,
  CAST(l.lo AS DOUBLE) AS line_rate_min, CAST(l.hi AS DOUBLE) AS line_rate_max,
  coalesce(abs(c.rate - l.lo) <= 0.005 AND abs(c.rate - l.hi) <= 0.005, FALSE) AS rates_agree
FROM crm_contracts c LEFT JOIN (SELECT contract_id, asset_id, min(rate) AS lo, max(rate) AS hi FROM lines GROUP BY 1, 2) l
USING (contract_id, asset_id)
""", ["crm_contracts", "lines"])
def rate_agreement(spark, sf_dir):
    return enterprise.rate_agreement(
        t.crm_contracts(spark, sf_dir), t.asset_contract_map(spark, sf_dir), t.invoice_lines(spark, sf_dir)
    ).withColumns({c: F.col(c).cast("double") for c in ("crm_rate", "map_rate", "line_rate_min", "line_rate_max")})


@query("active_contracts", """
SELECT fact_record_hash, i.c.c AS sf_contract_id FROM facts LEFT JOIN in_force i USING (contract_id, asset_id, market_date)
""", ["facts", "in_force"])
def active_contracts(spark, sf_dir):
    return enterprise.active_contract(facts(spark, sf_dir, stored=True), t.crm_contracts(spark, sf_dir)).select(
        "fact_record_hash", "sf_contract_id"
    )
