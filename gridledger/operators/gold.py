"""The leakage fact and what is reported from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridledger.functions.scalars import hash_key, parse_time, positive, time_text
from gridledger.operators.silver import dedupe_events

_HOUR = "reconciliation_hour_utc"


def typed_hour(df: DataFrame) -> DataFrame:
    """Market extracts carry the hour as text; a timestamp is left as it is."""
    if dict(df.dtypes)[_HOUR] != "string":
        return df
    return df.withColumn(_HOUR, parse_time(_HOUR))


def first_curtailment(events: DataFrame) -> DataFrame:
    """One event per asset and hour, the smallest id; a second one would double the fact."""
    return dedupe_events(events, ["asset_id", _HOUR], ["curtailment_event_id"])


def extra_curtailments(events: DataFrame) -> DataFrame:
    """Asset-hours with more than one event, and how many were set aside."""
    return (
        events.groupBy("asset_id", _HOUR)
        .agg(F.min("curtailment_event_id").alias("kept_event_id"), (F.count("*") - 1).alias("extra_events"))
        .filter(F.col("extra_events") > 0)
    )


def with_shortfall(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "physical_shortfall_mwh", positive(F.col("expected_available_mwh") - F.col("actual_generation_mwh"))
    )


def with_curtailment(df: DataFrame) -> DataFrame:
    lost = positive(F.col("expected_available_mwh") - F.col("grid_limited_mwh"))
    return df.withColumn(
        "grid_curtailment_mwh", F.when(F.col("curtailment_event_id").isNotNull(), lost).otherwise(F.lit(0.0))
    )


def _with_compensation(df: DataFrame, compensable: Column) -> DataFrame:
    applies = F.coalesce(compensable, F.lit(False)) & F.col("curtailment_event_id").isNotNull()
    return df.withColumn("is_compensable", applies).withColumn(
        "eligible_compensable_mwh", F.when(F.col("is_compensable"), F.col("grid_curtailment_mwh")).otherwise(F.lit(0.0))
    )


def with_eligibility(df: DataFrame) -> DataFrame:
    """Curtailed energy the contract pays for: its flag is Y and an event matched."""
    return _with_compensation(df, F.col("curtailment_compensable_flag") == "Y")


def with_reason_eligibility(df: DataFrame) -> DataFrame:
    """Eligibility by the contract's flag for the reason of the event."""
    reason = F.col("curtailment_reason")
    return _with_compensation(
        df,
        F.when(reason == "CONGESTION", F.col("congestion_curtailment_compensable"))
        .when(reason == "TRANSMISSION_CONSTRAINT", F.col("transmission_constraint_compensable"))
        .when(reason == "NEGATIVE_PRICE", F.col("negative_price_curtailment_compensable")),
    )


def with_expected(df: DataFrame) -> DataFrame:
    owed = F.col("eligible_compensable_mwh") * F.col("contract_rate_per_mwh")
    return df.withColumn("expected_settlement_usd", F.when(F.col("is_compensable"), owed).otherwise(F.lit(0.0)))


def with_leakage(df: DataFrame) -> DataFrame:
    """What is owed above what was paid; an unknown rate gives zero."""
    return df.withColumn(
        "estimated_leakage_revenue_usd", positive(F.col("expected_settlement_usd") - F.col("actual_settlement_usd"))
    )


def build_gold(
    hourly: DataFrame, assets: DataFrame, contracts: DataFrame, curtailment: DataFrame, settlements: DataFrame
) -> DataFrame:
    """One row per hour, asset and contract.

    Samples are already rolled up, so every join here is at hourly grain, and
    the market sides are unique on their join keys.
    """
    registry = assets.select("asset_id", "equip_name", "asset_type", "iso_region")
    terms = contracts.select(
        F.col("site_identity_tag").alias("asset_id"), "account_id", "oftaker_name", "associated_ppa_id",
        F.col("contract_rate_per_mwh").cast("double").alias("contract_rate_per_mwh"),
        "curtailment_compensable_flag", "settlement_method",
    )
    events = first_curtailment(
        typed_hour(curtailment).select("asset_id", _HOUR, "curtailment_event_id", "curtailment_reason")
    )
    paid = typed_hour(settlements).groupBy("asset_id", "associated_ppa_id", _HOUR).agg(
        F.sum(F.col("actual_settlement_usd").cast("double")).alias("paid_usd")
    )
    joined = (
        hourly.join(registry, "asset_id")
        .join(terms, "asset_id")
        .join(events, ["asset_id", _HOUR], "left")
        .join(paid, ["asset_id", "associated_ppa_id", _HOUR], "left")
        .withColumn("actual_settlement_usd", F.coalesce("paid_usd", F.lit(0.0)))
        .drop("paid_usd")
    )
    measured = with_leakage(with_expected(with_eligibility(with_curtailment(with_shortfall(joined)))))
    return measured.withColumn("fact_record_hash", hash_key(time_text(_HOUR), "asset_id", "associated_ppa_id"))


def stamp(gold: DataFrame, at: Column | None = None) -> DataFrame:
    return gold.withColumn("gold_calculated_at", F.current_timestamp() if at is None else at)


def material(gold: DataFrame, usd: float = 5000.0, ratio: float = 0.01) -> DataFrame:
    """Positive variance above the amount, or above the share of the expected settlement."""
    leak = F.col("estimated_leakage_revenue_usd")
    return gold.filter((leak > 0) & ((leak >= usd) | (leak >= ratio * F.col("expected_settlement_usd"))))


def unmapped_assets(silver: DataFrame, contracts: DataFrame) -> DataFrame:
    """Assets with telemetry and no contract; samples are counted per asset before the join."""
    seen = silver.groupBy("asset_id").agg(
        F.count("*").alias("sample_count"), F.min("event_ts_utc").alias("first_seen"),
        F.max("event_ts_utc").alias("last_seen"),
    )
    mapped = contracts.select(F.col("site_identity_tag").alias("asset_id"))
    return seen.join(mapped, "asset_id", "left_anti")


def leakage_by(gold: DataFrame, *dims: str) -> DataFrame:
    return gold.groupBy(*dims).agg(
        F.count("*").alias("fact_rows"),
        F.sum("grid_curtailment_mwh").alias("curtailment_mwh"),
        F.sum("eligible_compensable_mwh").alias("eligible_mwh"),
        F.sum(F.col("expected_settlement_usd") - F.col("actual_settlement_usd")).alias("settlement_variance_usd"),
        F.sum("estimated_leakage_revenue_usd").alias("leakage_usd"),
    )


def leakage_cube(gold: DataFrame) -> DataFrame:
    """Slices by asset, region and offtaker plus the total, in one pass."""
    slices = [["asset_id"], ["iso_region"], ["oftaker_name"], []]
    return gold.groupingSets(
        [[F.col(c) for c in s] for s in slices], "asset_id", "iso_region", "oftaker_name"
    ).agg(
        F.grouping_id().cast("int").alias("slice_id"),
        F.count("*").alias("fact_rows"),
        F.sum("estimated_leakage_revenue_usd").alias("leakage_usd"),
    )


def top_leakage(gold: DataFrame, dim: str, n: int) -> DataFrame:
    """The n largest values of a dimension by leakage, ties by name."""
    return leakage_by(gold, dim).orderBy(F.desc("leakage_usd"), dim).limit(n)


def leakage_running(gold: DataFrame) -> DataFrame:
    """Running leakage and share per contract, over time.

    Running sums are formed inside (contract, hour), over the assets of a
    contract, and shifted by the total of the earlier hours. Only one row per
    hour reaches the window over a contract, so a contract that holds much of
    the fact is not one task.
    """
    rows = gold.select("associated_ppa_id", _HOUR, "asset_id", "estimated_leakage_revenue_usd")
    hours = rows.groupBy("associated_ppa_id", _HOUR).agg(F.sum("estimated_leakage_revenue_usd").alias("_usd"))
    by_contract = W.partitionBy("associated_ppa_id")
    before = by_contract.orderBy(_HOUR).rowsBetween(W.unboundedPreceding, -1)
    offsets = hours.select(
        "associated_ppa_id", _HOUR,
        F.coalesce(F.sum("_usd").over(before), F.lit(0.0)).alias("_before"),
        F.sum("_usd").over(by_contract).alias("_total"),
    )
    in_hour = W.partitionBy("associated_ppa_id", _HOUR).orderBy("asset_id")
    running = F.sum("estimated_leakage_revenue_usd").over(in_hour.rowsBetween(W.unboundedPreceding, 0))
    return (
        rows.withColumn("_in_hour", running)
        .join(offsets, ["associated_ppa_id", _HOUR])
        .select(
            "associated_ppa_id", _HOUR, "asset_id", "estimated_leakage_revenue_usd",
            (F.col("_before") + F.col("_in_hour")).alias("running_leakage_usd"),
            F.try_divide("estimated_leakage_revenue_usd", "_total").alias("contract_share"),
        )
    )


def run_summary(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count("*").alias("fact_rows"),
        F.count_distinct("asset_id").alias("asset_count"),
        F.count_distinct("associated_ppa_id").alias("contract_count"),
        F.min(_HOUR).alias("first_hour"),
        F.max(_HOUR).alias("last_hour"),
        F.sum("estimated_leakage_revenue_usd").alias("leakage_usd"),
    )


def two_sided_settlement(df: DataFrame) -> DataFrame:
    """Market revenue, contract difference payment, their total and possible compensation."""
    actual, price, rate = F.col("actual_generation_mwh"), F.col("market_price_usd_per_mwh"), F.col(
        "contract_rate_per_mwh"
    )
    return df.withColumns({
        "market_revenue_usd": actual * price,
        "contract_difference_usd": actual * (rate - price),
        "potential_compensation_usd": F.col("eligible_compensable_mwh") * rate,
    }).withColumn("total_revenue_usd", F.col("market_revenue_usd") + F.col("contract_difference_usd"))


def reconcile_statements(gold: DataFrame, statements: DataFrame, tolerance_usd: float = 0.01) -> DataFrame:
    """Fact against settlement statement per asset, contract and market date."""
    keys = ["asset_id", "contract_id", "market_date"]
    ours = gold.groupBy(
        "asset_id", F.col("associated_ppa_id").alias("contract_id"), F.to_date(_HOUR).alias("market_date")
    ).agg(F.sum("estimated_leakage_revenue_usd").alias("fact_usd"), F.lit(True).alias("_ours"))
    theirs = statements.groupBy(*keys).agg(
        F.sum("estimated_leakage_revenue_usd").alias("statement_usd"), F.lit(True).alias("_theirs"))
    status = (
        F.when(F.col("_ours").isNull(), "MISSING_IN_FACT")
        .when(F.col("_theirs").isNull(), "MISSING_IN_STATEMENT")
        .when(F.col("fact_usd").isNull() != F.col("statement_usd").isNull(), "AMOUNT_MISMATCH")
        .when(F.abs(F.col("fact_usd") - F.col("statement_usd")) > tolerance_usd, "AMOUNT_MISMATCH")
        .otherwise("MATCHED")
    )
    return ours.join(theirs, keys, "full_outer").withColumn("reconciliation_status", status).drop("_ours", "_theirs")
