"""Declarative data-quality checks and the gate built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named check; ``failed`` counts failures in one pass over the dataset."""

    name: str
    failed: Column | None = None
    duplicate_keys: tuple[str, ...] = ()


def row_count_positive() -> Check:
    return Check("row_count > 0", F.when(F.count("*") > 0, F.lit(0)).otherwise(F.lit(1)))


def not_missing(column: str) -> Check:
    return Check(f"missing_count({column}) = 0", F.count_if(F.col(column).isNull()))


def unique(*columns: str) -> Check:
    return Check(f"duplicate_count({','.join(columns)}) = 0", duplicate_keys=columns)


def no_rows(name: str, broken: Column) -> Check:
    return Check(name, F.count_if(broken))


def non_negative(column: str) -> Check:
    return no_rows(f"{column} must be non-negative", F.col(column) < 0)


def accepted(column: str, values: list) -> Check:
    return no_rows(f"{column} has accepted values", ~F.col(column).isin(*values))


def compensable_consistent() -> Check:
    eligible, lost = F.col("eligible_compensable_mwh"), F.col("grid_curtailment_mwh")
    wrong = (eligible > lost) | ((F.col("curtailment_compensable_flag") != "Y") & (eligible != 0))
    return no_rows("compensable MWh is consistent", wrong)


def checks_from_spec(spec: list[dict]) -> list[Check]:
    """Checks from plain dictionaries, as read from a configuration file.

    Forms: ``{"row_count": "positive"}``, ``{"missing": col}``,
    ``{"unique": [cols]}``, ``{"non_negative": col}``,
    ``{"accepted": col, "values": [...]}`` and ``{"failed_rows": name, "where": sql}``.
    """
    checks = []
    for item in spec:
        if "row_count" in item:
            checks.append(row_count_positive())
        elif "missing" in item:
            checks.append(not_missing(item["missing"]))
        elif "unique" in item:
            checks.append(unique(*item["unique"]))
        elif "non_negative" in item:
            checks.append(non_negative(item["non_negative"]))
        elif "accepted" in item:
            checks.append(accepted(item["accepted"], item["values"]))
        elif "failed_rows" in item:
            checks.append(no_rows(item["failed_rows"], F.expr(item["where"])))
        else:
            raise ValueError(f"unknown check: {item}")
    return checks


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def run_checks(df: DataFrame, dataset: str, checks: list[Check], at: Column | None = None) -> DataFrame:
    """One row per check. All counting checks share a single aggregate."""
    counted = [c for c in checks if c.failed is not None]
    parts = []
    if counted:
        row = df.agg(*[c.failed.cast("long").alias(f"c{i}") for i, c in enumerate(counted)])
        pairs = F.array(*[
            F.struct(F.lit(c.name).alias("check_name"), F.col(f"c{i}").alias("failed_count"))
            for i, c in enumerate(counted)
        ])
        parts.append(row.select(F.inline(pairs)))
    for check in checks:
        if check.duplicate_keys:
            parts.append(
                duplicate_keys(df, *check.duplicate_keys).agg(
                    F.lit(check.name).alias("check_name"), F.count("*").alias("failed_count")
                )
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(
        F.lit(dataset).alias("dataset"), "check_name",
        (F.col("failed_count") == 0).alias("passed"), "failed_count",
        (F.current_timestamp() if at is None else at).alias("checked_at"),
    )


def gate(results: DataFrame) -> DataFrame:
    """PASSED or FAILED per dataset."""
    return results.groupBy("dataset").agg(
        F.when(F.bool_and("passed"), "PASSED").otherwise("FAILED").alias("dq_gate_status"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
    )


def gate_status(results: DataFrame, dataset: str) -> str:
    """The gate of one dataset as a value; a dataset that was not checked has failed."""
    row = gate(results.filter(F.col("dataset") == dataset)).first()
    return row.dq_gate_status if row else "FAILED"


class QualityGateError(RuntimeError):
    """Raised when a dataset must not go downstream."""


def require_passed(results: DataFrame) -> None:
    """Raise when a check failed; there is one result row per declared check."""
    failed = results.filter(~F.col("passed")).select("dataset", "check_name", "failed_count").collect()
    if failed:
        raise QualityGateError("; ".join(f"{r.dataset}: {r.check_name} ({r.failed_count})" for r in failed))


def partition_difference(source: DataFrame, valid: DataFrame, quarantine: DataFrame, key: str) -> DataFrame:
    """Keys lost or added when a source was split; empty when the split is whole.

    Source rows count up and part rows count down, so one aggregate with
    map-side reduction compares both sides, copies included.
    """
    signed = (
        source.select(key, F.lit(1).alias("_n"))
        .unionByName(valid.select(key, F.lit(-1).alias("_n")))
        .unionByName(quarantine.select(key, F.lit(-1).alias("_n")))
    )
    return (
        signed.groupBy(key).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
        .select(key, F.when(F.col("_n") > 0, "lost").otherwise("added").alias("side"), F.abs("_n").alias("copies"))
    )
