import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridledger.operators import cases, enterprise, gold

HOUR = dt.datetime(2026, 6, 23, 10)


def build(spark, expected=100.0, actual=60.0, limited=60.0, flag="Y", events=1, paid=(1000.0,), rate="42.50"):
    hourly = spark.createDataFrame(
        [(HOUR, "W", "CURTAILED_BY_ERCOT", 360, actual, expected, limited)],
        "reconciliation_hour_utc timestamp, asset_id string, curtailment_status string, sample_count long, "
        "actual_generation_mwh double, expected_available_mwh double, grid_limited_mwh double")
    assets = spark.createDataFrame([("W", "Wind", "WIND", "ERCOT")], "asset_id string, equip_name string, asset_type string, iso_region string")
    contracts = spark.createDataFrame(
        [("ACC", "Buyer", "PPA1", "W", rate, flag, "FIXED")],
        "account_id string, oftaker_name string, associated_ppa_id string, site_identity_tag string, contract_rate_per_mwh string, "
        "curtailment_compensable_flag string, settlement_method string")
    ce = spark.createDataFrame(
        [(f"C{i}", "W", "2026-06-23 10:00:00", "CONGESTION") for i in range(events)],
        "curtailment_event_id string, asset_id string, reconciliation_hour_utc string, curtailment_reason string")
    settlements = spark.createDataFrame(
        [("W", "PPA1", "2026-06-23 10:00:00", p) for p in paid],
        "asset_id string, associated_ppa_id string, reconciliation_hour_utc string, actual_settlement_usd double")
    return gold.build_gold(hourly, assets, contracts, ce, settlements)


def test_leakage_of_a_compensable_hour(spark):
    row = build(spark).first()
    assert (row.physical_shortfall_mwh, row.grid_curtailment_mwh, row.eligible_compensable_mwh) == (40.0, 40.0, 40.0)
    assert row.expected_settlement_usd == 1700.0 and row.estimated_leakage_revenue_usd == 700.0


def test_hash_is_of_hour_asset_and_contract(spark):
    import hashlib

    assert build(spark).first().fact_record_hash == hashlib.sha256(b"2026-06-23 10:00:00|W|PPA1").hexdigest()


def test_not_compensable_or_no_event_is_no_leakage(spark):
    assert build(spark, flag="N").first().estimated_leakage_revenue_usd == 0.0
    row = build(spark, events=0).first()
    assert row.grid_curtailment_mwh == 0.0 and row.physical_shortfall_mwh == 40.0


def test_second_event_and_second_payment_do_not_double_the_fact(spark):
    rows = build(spark, events=3, paid=(400.0, 300.0)).collect()
    assert len(rows) == 1 and rows[0].curtailment_event_id == "C0" and rows[0].actual_settlement_usd == 700.0


def test_no_payment_counts_as_zero_and_overpayment_as_no_leakage(spark):
    assert build(spark, paid=()).first().estimated_leakage_revenue_usd == 1700.0
    assert build(spark, paid=(5000.0,)).first().estimated_leakage_revenue_usd == 0.0


def test_unknown_rate_and_refunds(spark):
    row = build(spark, rate=None, paid=(-5.0,)).first()
    assert row.expected_settlement_usd is None and row.estimated_leakage_revenue_usd == 0.0
    assert build(spark, rate=None, flag="N").first().expected_settlement_usd == 0.0
    assert build(spark, paid=(-100.0,)).first().estimated_leakage_revenue_usd == 1800.0


def test_null_expected_power_gives_zero(spark):
    row = build(spark, expected=None).first()
    assert row.physical_shortfall_mwh == 0.0 and row.estimated_leakage_revenue_usd == 0.0


@pytest.mark.parametrize("mwh,rate,usd", [(17.675, 42.5, 751.19), (14.117, 38.75, 547.03), (4.083, 45.0, 183.74)])
def test_statement_amounts(spark, mwh, rate, usd):
    row = spark.createDataFrame([(mwh, rate, True)], "eligible_compensable_mwh double, contract_rate_per_mwh double, is_compensable boolean")
    assert round(gold.with_expected(row).first().expected_settlement_usd, 2) == usd


def test_reason_flags(spark):
    rows = spark.createDataFrame(
        [("CONGESTION", "E", True, False, False, 5.0), ("NEGATIVE_PRICE", "E", True, True, False, 5.0),
         ("MAINTENANCE", "E", True, True, True, 5.0), ("CONGESTION", None, True, True, True, 5.0)],
        "curtailment_reason string, curtailment_event_id string, congestion_curtailment_compensable boolean, "
        "transmission_constraint_compensable boolean, negative_price_curtailment_compensable boolean, grid_curtailment_mwh double")
    assert [r.eligible_compensable_mwh for r in gold.with_reason_eligibility(rows).collect()] == [5.0, 0.0, 0.0, 0.0]


def test_material(spark):
    rows = spark.createDataFrame([(0.0, 100.0), (0.5, 100.0), (2.0, 100.0), (6000.0, 1e9)],
                                 "estimated_leakage_revenue_usd double, expected_settlement_usd double")
    assert sorted(r[0] for r in gold.material(rows).collect()) == [2.0, 6000.0]


def test_reconciliation_statuses(spark):
    facts = build(spark)
    statement = spark.createDataFrame(
        [("W", "PPA1", dt.date(2026, 6, 23), 700.004), ("S", "PPA2", dt.date(2026, 6, 23), 1.0)],
        "asset_id string, contract_id string, market_date date, estimated_leakage_revenue_usd double")
    out = {r.asset_id: r.reconciliation_status for r in gold.reconcile_statements(facts, statement).collect()}
    assert out == {"W": "MATCHED", "S": "MISSING_IN_FACT"}


def test_running_leakage_with_a_hot_contract(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("associated_ppa_id"),
        F.expr("timestamp'2026-01-01' + make_dt_interval(0, cast(id % 500 as int))").alias("reconciliation_hour_utc"),
        F.col("id").cast("string").alias("asset_id"), (F.col("id") % 7).cast("double").alias("estimated_leakage_revenue_usd"),
    )
    out = gold.leakage_running(rows).filter("associated_ppa_id = 'hot'").orderBy("reconciliation_hour_utc", "asset_id").collect()
    total = 0.0
    for r in out:
        total += r.estimated_leakage_revenue_usd
        assert r.running_leakage_usd == total
    assert len(out) == 2000 and sum(r.contract_share for r in out) == pytest.approx(1.0)


def test_breaches_only_leave_a_passed_gate(spark):
    facts = build(spark)
    assert cases.breach_events(facts).first().breach_severity == "HIGH"
    assert cases.breach_events(facts, "FAILED").count() == 0


def test_enterprise_typing_and_open_disputes(spark):
    from pyspark.sql import types as T

    text = spark.createDataFrame([("1", "2026-06-23", "12.50", "True"), ("2", "", "abc", "")], "id string, d string, amount string, flag string")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("d", T.DateType()),
                           T.StructField("amount", T.DecimalType(18, 2)), T.StructField("flag", T.BooleanType())])
    first, second = enterprise.curate_enterprise(text, schema).orderBy("id").collect()
    assert first.d == dt.date(2026, 6, 23) and str(first.amount) == "12.50" and first.flag is True
    assert second.d is None and second.amount is None and second.flag is None

    disputes = spark.createDataFrame(
        [("W", "P", dt.date(2026, 6, 23), "Closed - Paid", "RD-1"), ("S", "Q", dt.date(2026, 6, 23), "In Review", "RD-2")],
        "asset_id string, contract_id string, market_date date, status string, dispute_number string")
    facts = disputes.select("asset_id", "contract_id", "market_date")
    out = {r.asset_id: r.existing_dispute_number for r in enterprise.with_disputes(facts, disputes).collect()}
    assert out == {"W": None, "S": "RD-2"}
    assert [r.asset_id for r in enterprise.new_cases_only(facts, disputes).collect()] == ["W"]


def test_newest_invoice_of_a_day_counts_and_lines_do_not_fan_out(spark):
    day = dt.date(2026, 6, 1)
    headers = spark.createDataFrame(
        [("I1", "P", "OPEN", dt.date(2026, 7, 1), day, dt.date(2026, 6, 30)), ("I2", "P", "PAID", dt.date(2026, 7, 3), day, day)],
        "invoice_id string, contract_id string, invoice_status string, invoice_date date, invoice_period_start date, invoice_period_end date")
    lines = spark.createDataFrame([("I1", "W", 1.0, 10.0), ("I1", "W", 2.0, 20.0), ("I2", "W", 5.0, 50.0)],
                                  "invoice_id string, asset_id string, billing_quantity_mwh double, line_amount_usd double")
    gl = spark.createDataFrame([("G1", "I1", "400", "PC", 30.0), ("G2", "I1", "400", "PC", 1.0)],
                               "accounting_doc_id string, invoice_id string, gl_account string, profit_center string, amount_usd double")
    ar = spark.createDataFrame([("I1", 30.0, "MONITOR")], "invoice_id string, open_amount_usd double, collections_status string")
    out = {r.market_date: r for r in enterprise.billing_days(headers, lines, gl, ar).collect()}
    assert len(out) == 30 and out[day].invoice_id == "I2" and out[dt.date(2026, 6, 2)].billed_usd == 30.0
    assert out[dt.date(2026, 6, 2)].accounting_doc_id == "G1" and out[dt.date(2026, 6, 2)].posted_usd == 31.0
