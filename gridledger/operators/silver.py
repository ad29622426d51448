"""Typed telemetry: parsing, validation, quarantine and de-duplication."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger import fixed_values as fv
from gridledger.functions.scalars import hour_of, is_curtailed, kw_to_mwh, non_null, parse_time, positive
from gridledger.functions.skew import BROADCAST_ROWS, lookup_join
from gridledger.profiles import METERED, TelemetryProfile
from gridledger.session import materialize

_KNOWN = "asset_is_known"
# Types of the first order column for which a maximum is kept at fixed width.
_FIXED_WIDTH = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def type_telemetry(bronze: DataFrame, profile: TelemetryProfile = METERED) -> DataFrame:
    """Common column names and a parsed event time; malformed time text gives null."""
    typed = bronze.withColumnsRenamed(profile.renames)
    if not profile.has_quality and "telemetry_quality" not in typed.columns:
        typed = typed.withColumn("telemetry_quality", F.lit(fv.VALID_QUALITY))
    if "grid_limit_kw" not in typed.columns:
        typed = typed.withColumn("grid_limit_kw", F.lit(None).cast("double"))
    return typed.withColumn("event_ts_utc", parse_time("timestamp_utc", profile.time_format)).drop("timestamp_utc")


def incremental(
    df: DataFrame, column: str, now: dt.datetime | Column, hours: int = fv.LOOKBACK_HOURS, full_refresh: bool = False
) -> DataFrame:
    """Rows not older than ``hours`` before ``now``; a full refresh keeps all.

    With a plain ``datetime`` the bound is a literal, so it reaches the file scan.
    """
    if full_refresh:
        return df
    if isinstance(now, Column):
        bound = now - F.make_dt_interval(hours=F.lit(hours))
    else:
        bound = F.lit(now - dt.timedelta(hours=hours))
    return df.filter(F.col(column) >= bound)


def _rules(profile: TelemetryProfile) -> list[tuple[str | None, Column]]:
    """Ordered (code, condition) pairs; a null condition lets the row through."""
    col = F.col
    rules: list[tuple[str | None, Column]] = [
        (fv.INVALID_TIMESTAMP, col("event_ts_utc").isNull()),
        (fv.MISSING_ASSET, col("asset_id").isNull()),
    ]
    if profile.asset_ids is not None:
        rules.append((fv.UNKNOWN_ASSET, ~col("asset_id").isin(*profile.asset_ids)))
    else:
        rules.append((fv.UNKNOWN_ASSET, ~col(_KNOWN)))
    rules += [
        (fv.NEGATIVE_GENERATION, col("measured_generation_kw") < 0),
        (fv.NEGATIVE_EXPECTED_BASELINE, col("expected_available_kw") < 0),
        (fv.NEGATIVE_GRID_LIMIT, col("grid_limit_kw") < 0),
        (fv.UNKNOWN_STATUS, ~col("operating_status").isin(*profile.statuses)),
    ]
    if profile.strict:
        for name in ("measured_generation_kw", "expected_available_kw", "operating_status"):
            rules.append((f"MISSING_{name.upper()}", col(name).isNull()))
        if profile.has_quality:
            rules.append(("MISSING_TELEMETRY_QUALITY", col("telemetry_quality").isNull()))
    # The quality mark itself is the code.
    rules.append((None, col("telemetry_quality") != fv.VALID_QUALITY))
    return rules


def _flag_known(typed: DataFrame, profile: TelemetryProfile, known_assets: DataFrame | None) -> DataFrame:
    if profile.asset_ids is not None:
        return typed
    if known_assets is None:
        return typed.withColumn(_KNOWN, F.lit(True))
    registry = known_assets.select("asset_id").distinct().withColumn("_listed", F.lit(True))
    return (
        lookup_join(typed, registry, ["asset_id"], ["event_id"], source=known_assets)
        .withColumn(_KNOWN, F.coalesce("_listed", F.lit(False)))
        .drop("_listed")
    )


def validation_code(profile: TelemetryProfile = METERED) -> Column:
    """The first rule a row breaks, or null."""
    code = None
    for name, broken in _rules(profile):
        value = F.col("telemetry_quality") if name is None else F.lit(name)
        code = F.when(broken, value) if code is None else code.when(broken, value)
    return code


def validation_reasons(profile: TelemetryProfile = METERED) -> Column:
    """Every rule a row breaks, in rule order."""
    return non_null(
        F.when(broken, F.col("telemetry_quality") if name is None else F.lit(name))
        for name, broken in _rules(profile)
    )


def validate(
    bronze: DataFrame, profile: TelemetryProfile = METERED, known_assets: DataFrame | None = None
) -> DataFrame:
    """Typed rows with ``validation_error_code``; the one scan both outputs share."""
    typed = _flag_known(type_telemetry(bronze, profile), profile, known_assets)
    return typed.withColumn("validation_error_code", validation_code(profile)).drop(_KNOWN)


def explain_failures(
    bronze: DataFrame, profile: TelemetryProfile = METERED, known_assets: DataFrame | None = None
) -> DataFrame:
    """All rows with the status and the full list of broken rules."""
    typed = _flag_known(type_telemetry(bronze, profile), profile, known_assets)
    reasons = typed.withColumn("dq_reasons", validation_reasons(profile))
    return reasons.withColumns({
        "dq_status": F.when(F.size("dq_reasons") == 0, "VALID").otherwise("INVALID"),
        "dq_error_reason": F.nullif(F.array_join("dq_reasons", ";"), F.lit("")),
    }).drop(_KNOWN)


def silver_valid(validated: DataFrame) -> DataFrame:
    """Clean rows with their reconciliation hour."""
    return (
        validated.filter(F.col("asset_id").isNotNull() & F.col("validation_error_code").isNull())
        .withColumn("reconciliation_hour_utc", hour_of("event_ts_utc"))
        .drop("validation_error_code", "raw_payload")
    )


def silver_quarantine(validated: DataFrame) -> DataFrame:
    """Failed rows with code and raw payload."""
    return validated.filter(F.col("validation_error_code").isNotNull())


def derive_metrics(valid: DataFrame, sample_seconds: float = fv.SAMPLE_SECONDS) -> DataFrame:
    """Per-sample energy and curtailment columns."""
    expected = kw_to_mwh(F.col("expected_available_kw"), sample_seconds)
    actual = kw_to_mwh(F.col("measured_generation_kw"), sample_seconds)
    return valid.withColumns({
        "source_date": F.to_date("event_ts_utc"),
        "expected_available_mwh": expected,
        "actual_generation_mwh": actual,
        "is_curtailment_event": F.coalesce(is_curtailed("operating_status"), F.lit(False)),
    }).withColumn(
        "curtailed_mwh",
        F.when(F.col("is_curtailment_event"),
               positive(F.col("expected_available_mwh") - F.col("actual_generation_mwh"))).otherwise(F.lit(0.0)),
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate rather than a window: copies of one key are reduced on the
    map side, so a key that holds many copies never fills one task.
    """
    return _pick(df, keys, order, F.max_by)


def dedupe_events(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, order, F.min_by)


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)


def latest_of_many(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``latest`` where a key has very many rows: a stored table that is read twice and not sorted."""
    return _pick_in_two(df, keys, order, F.max_by)


def first_of_many(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``dedupe_events`` where a key has very many rows."""
    return _pick_in_two(df, keys, order, F.min_by)


def _pick_in_two(df: DataFrame, keys: list[str], order: list[str], pick, max_keys: int = BROADCAST_ROWS) -> DataFrame:
    """Pick by two phases: the best first order value per key, then the rows that have it.

    The first phase reads keys and one number or time, which a hash aggregate
    holds at fixed width. Its written result is broadcast to the rows, so rows
    are neither sorted nor moved; ties and further order columns are settled
    among the few that are left. A null order value ranks lowest, null keys
    are a key. If there are too many keys to broadcast, they have few rows
    each, and one aggregate over the rows moves less than a join.
    """
    if dict(df.dtypes)[order[0]] not in _FIXED_WIDTH:
        return _pick(df, keys, order, pick)
    value = F.col(order[0])
    best = F.max(value)
    if pick is F.min_by:
        best = F.when(F.count_if(value.isNull()) == 0, F.min(value))
    bests = materialize(df.groupBy(*keys).agg(best.alias("_best")), "best-values")
    if bests.limit(max_keys + 1).count() > max_keys:
        return _pick(df, keys, order, pick)
    named = bests.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_best")
    same = [df[k].eqNullSafe(named[f"_key_{i}"]) for i, k in enumerate(keys)] + [df[order[0]].eqNullSafe(named["_best"])]
    return _pick(df.join(F.broadcast(named), reduce(and_, same), "left_semi"), keys, order, pick)


def row_accounting(validated: DataFrame, by: Column | None = None) -> DataFrame:
    """Rows read, written and quarantined, in one pass."""
    grouped = validated.groupBy(by) if by is not None else validated.groupBy()
    code = F.col("validation_error_code")
    return grouped.agg(
        F.count("*").alias("rows_read"),
        F.count_if(code.isNull()).alias("rows_written"),
        F.count_if(code.isNotNull()).alias("rows_quarantined"),
    )
