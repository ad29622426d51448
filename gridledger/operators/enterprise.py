"""Finance and commercial context: typing, joins and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.functions.scalars import days_between, strip
from gridledger.functions.skew import lookup_join

_DAY_KEYS = ["asset_id", "contract_id", "market_date"]


def curate_enterprise(extract: DataFrame, schema: T.StructType) -> DataFrame:
    """All-text extract to typed columns; blank or malformed text becomes null."""

    def typed(field: T.StructField) -> Column:
        text = F.nullif(strip(F.col(field.name)), F.lit(""))
        return (text if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)).alias(field.name)

    return extract.select([typed(f) for f in schema.fields])


def derive_ar(headers: DataFrame) -> DataFrame:
    """Receivable item of an invoice: paid amount and collections state from the open amount."""
    return headers.select(
        F.concat(F.lit("AR-"), "invoice_id").alias("open_item_id"),
        "invoice_id", "contract_id", "due_date",
        F.col("invoice_status").alias("payment_status"),
        (F.col("gross_amount_usd") - F.col("open_amount_usd")).alias("paid_amount_usd"),
        "open_amount_usd",
        F.when(F.col("open_amount_usd") == 0, "NORMAL").otherwise("MONITOR").alias("collections_status"),
    )


def billing_days(headers: DataFrame, lines: DataFrame, gl: DataFrame, ar: DataFrame) -> DataFrame:
    """One invoice per asset, contract and day it covers, with posting and receivable.

    Lines, postings and receivables are reduced to one row per invoice side
    before any join, so amounts cannot multiply. Of several invoices for one
    day the newest stays.
    """
    billed = lines.groupBy("invoice_id", "asset_id").agg(
        F.sum("billing_quantity_mwh").alias("billed_mwh"), F.sum("line_amount_usd").alias("billed_usd")
    )
    posted = gl.groupBy("invoice_id").agg(
        F.min_by(F.struct("accounting_doc_id", "gl_account", "profit_center"), "accounting_doc_id").alias("p"),
        F.sum("amount_usd").alias("posted_usd"),
    ).select("invoice_id", "p.*", "posted_usd")
    due = ar.groupBy("invoice_id").agg(
        F.sum("open_amount_usd").alias("open_amount_usd"), F.max("collections_status").alias("collections_status")
    )
    invoices = (
        headers.select("invoice_id", "contract_id", "invoice_status", "invoice_date",
                       "invoice_period_start", "invoice_period_end")
        .join(billed, "invoice_id")
        .join(posted, "invoice_id", "left")
        .join(due, "invoice_id", "left")
    )
    covered = F.explode(F.sequence("invoice_period_start", "invoice_period_end"))
    detail = [c for c in invoices.columns if c not in ("asset_id", "contract_id")]
    return (
        invoices.filter(F.col("invoice_period_start") <= F.col("invoice_period_end"))
        .withColumn("market_date", covered)
        .groupBy(*_DAY_KEYS)
        .agg(F.max_by(F.struct(*detail), F.struct("invoice_date", "invoice_id")).alias("i"))
        .select(*_DAY_KEYS, "i.*")
    )


def with_finance(facts: DataFrame, headers: DataFrame, lines: DataFrame, gl: DataFrame, ar: DataFrame) -> DataFrame:
    """Facts with the invoice of their day, its posting and its receivable.

    ``facts`` should be a stored table: lines of assets and contracts without
    facts are left out before anything is summed.
    """
    pair = ["asset_id", "contract_id"]
    needed = lookup_join(lines, facts.select(*pair).distinct(), pair, ["invoice_id"], "left_semi")
    days = billing_days(headers, needed, gl, ar).drop("invoice_period_start", "invoice_period_end")
    return facts.join(days, _DAY_KEYS, "left")


def contract_in_force(facts: DataFrame, contracts: DataFrame) -> DataFrame:
    """The activated contract in force per asset, contract and market date of the facts, where there is one."""
    terms = contracts.filter(F.col("contract_status") == "Activated").select(
        "contract_id", "asset_id", "sf_contract_id", "sf_account_id", "contract_name", "start_date", "end_date"
    )
    keys = ["contract_id", "asset_id"]
    return (
        facts.select(*_DAY_KEYS).distinct().join(terms, keys)
        .filter(F.col("market_date").between(F.col("start_date"), F.coalesce("end_date", F.lit("9999-12-31").cast("date"))))
        .groupBy(*_DAY_KEYS)
        .agg(F.max_by(F.struct("sf_contract_id", "sf_account_id", "contract_name"),
                      F.struct("start_date", "sf_contract_id")).alias("c"))
        .select(*_DAY_KEYS, "c.*")
    )


def active_contract(facts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Facts with the activated contract in force on their market date, if any."""
    return facts.join(contract_in_force(facts, contracts), _DAY_KEYS, "left")


def with_commercial(facts: DataFrame, accounts: DataFrame, contracts: DataFrame, assets: DataFrame) -> DataFrame:
    """Facts with contract in force, account and CRM asset.

    A split join reads its left side twice. So equipment is joined before the
    other columns are, and accounts to the contracts in force, not to the facts.
    """
    named = accounts.select("sf_account_id", "account_name", "account_status", "risk_tier")
    equipment = assets.groupBy("asset_id").agg(F.min("sf_asset_id").alias("sf_asset_id"))
    in_force = lookup_join(contract_in_force(facts, contracts), named, ["sf_account_id"], _DAY_KEYS)
    known = lookup_join(facts, equipment, ["asset_id"], _DAY_KEYS, source=assets).join(in_force, _DAY_KEYS, "left")
    return known.select(
        "asset_id", "sf_account_id", "contract_id", "market_date", *[c for c in facts.columns if c not in _DAY_KEYS],
        "sf_contract_id", "contract_name", "account_name", "account_status", "risk_tier", "sf_asset_id",
    )


def is_open(status: Column) -> Column:
    return ~status.startswith("Closed")


def open_disputes(disputes: DataFrame) -> DataFrame:
    return disputes.filter(is_open(F.col("status"))).groupBy(*_DAY_KEYS).agg(
        F.min("dispute_number").alias("existing_dispute_number"), F.count("*").alias("open_dispute_count")
    )


def with_disputes(facts: DataFrame, disputes: DataFrame) -> DataFrame:
    return (
        facts.join(open_disputes(disputes), _DAY_KEYS, "left")
        .withColumn("existing_open_dispute_flag", F.col("existing_dispute_number").isNotNull())
        .withColumn("open_dispute_count", F.coalesce("open_dispute_count", F.lit(0)))
    )


def new_cases_only(facts: DataFrame, disputes: DataFrame) -> DataFrame:
    return facts.join(open_disputes(disputes), _DAY_KEYS, "left_anti")


def match_customers(partners: DataFrame, accounts: DataFrame) -> DataFrame:
    """Business partners against CRM accounts on both ids."""
    keys = ["sap_customer_number", "sf_account_id"]
    status = (
        F.when(F.col("_in_crm").isNull(), "MISSING_IN_CRM")
        .when(F.col("_in_erp").isNull(), "MISSING_IN_ERP")
        .when(~F.col("business_partner_name").eqNullSafe(F.col("account_name")), "NAME_MISMATCH")
        .otherwise("MATCHED")
    )
    return (
        partners.select(*keys, "business_partner_name", F.lit(True).alias("_in_erp"))
        .join(accounts.select(*keys, "account_name", F.lit(True).alias("_in_crm")), keys, "full_outer")
        .withColumn("match_status", status).drop("_in_erp", "_in_crm")
    )


def metering_variance(energy: DataFrame, lines: DataFrame, period: str = "billing_period") -> DataFrame:
    """Metered against invoiced MWh per asset and billing period."""
    metered = energy.groupBy("asset_id", period).agg(F.sum("actual_generation_mwh").alias("metered_mwh"))
    invoiced = lines.groupBy("asset_id", period).agg(F.sum("billing_quantity_mwh").alias("invoiced_mwh"))
    return metered.join(invoiced, ["asset_id", period], "left").withColumn(
        "variance_mwh", F.col("metered_mwh") - F.coalesce("invoiced_mwh", F.lit(0))
    )


def uninvoiced(facts: DataFrame, billed_days: DataFrame) -> DataFrame:
    """Compensable amounts on days no invoice covers."""
    return facts.filter(F.col("expected_settlement_usd") > 0).join(
        billed_days.select(*_DAY_KEYS).distinct(), _DAY_KEYS, "left_anti"
    )


def finance_consistency(headers: DataFrame, lines: DataFrame, gl: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per invoice: paid plus open, priced lines, line total and postings against the gross amount."""
    off_price = F.abs(
        F.col("line_amount_usd") - F.col("billing_quantity_mwh") * F.col("contract_rate_usd_per_mwh")
    ) > tolerance
    by_line = lines.groupBy("invoice_id").agg(
        F.sum("line_amount_usd").alias("lines_usd"), F.count_if(off_price).alias("mispriced_lines")
    )
    posted = gl.groupBy("invoice_id").agg(F.sum("amount_usd").alias("posted_usd"))

    def differs(amount: Column) -> Column:
        return F.coalesce(F.abs(F.col("gross_amount_usd") - amount) > tolerance, F.lit(True))

    return (
        headers.join(by_line, "invoice_id", "left").join(posted, "invoice_id", "left")
        .select(
            "invoice_id", "gross_amount_usd", "lines_usd", "posted_usd",
            F.coalesce("mispriced_lines", F.lit(0)).alias("mispriced_lines"),
            differs(F.col("paid_amount_usd") + F.col("open_amount_usd")).alias("paid_open_differs"),
            differs(F.col("lines_usd")).alias("lines_differ"),
            differs(F.col("posted_usd")).alias("posting_differs"),
        )
    )


def rate_agreement(contracts: DataFrame, mapping: DataFrame, lines: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Contract rate in CRM, asset map and invoice lines, per contract and asset."""
    keys = ["contract_id", "asset_id"]
    rate = "contract_rate_usd_per_mwh"
    crm = contracts.groupBy(*keys).agg(F.max(rate).alias("crm_rate"))
    mapped = mapping.groupBy(*keys).agg(F.max(rate).alias("map_rate"))
    billed = lines.groupBy(*keys).agg(F.min(rate).alias("line_rate_min"), F.max(rate).alias("line_rate_max"))
    agree = (
        (F.abs(F.col("crm_rate") - F.col("map_rate")) <= tolerance)
        & (F.abs(F.col("crm_rate") - F.col("line_rate_min")) <= tolerance)
        & (F.abs(F.col("crm_rate") - F.col("line_rate_max")) <= tolerance)
    )
    return (
        crm.join(mapped, keys, "full_outer").join(billed, keys, "full_outer")
        .withColumn("rates_agree", F.coalesce(agree, F.lit(False)))
    )


def days_past_due(ar: DataFrame, as_of: Column) -> DataFrame:
    return ar.withColumn(
        "days_past_due",
        F.when(F.col("open_amount_usd") > 0, F.greatest(days_between(as_of, "due_date"), F.lit(0))).otherwise(F.lit(0)),
    )
