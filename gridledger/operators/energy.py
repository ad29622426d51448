"""Energy from samples: rollups, curtailment episodes and notice matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridledger import fixed_values as fv
from gridledger.functions.scalars import is_curtailed, kw_to_mwh, seconds_between
from gridledger.functions.skew import lookup_join
from gridledger.profiles import METERED, TelemetryProfile
from gridledger.session import materialize

# Levels of the notice index and their bucket widths; a notice of up to FINE_LIMIT fine widths is a fine one.
FINE, COARSE, OPEN = 0, 1, 2
FINE_SECONDS, COARSE_SECONDS = 3600, 30 * 24 * 3600
FINE_LIMIT = 48


def _curtailment_status(profile: TelemetryProfile) -> Column:
    """The alphabetically last curtailed status of a group.

    Statuses are compared as small integers: a text maximum would force a
    sort-based aggregate over the raw samples.
    """
    names = sorted(s for s in profile.statuses if s.startswith(fv.CURTAILED_PREFIX))
    status, code = F.col("operating_status"), None
    for position, name in enumerate(names, start=1):
        code = F.when(status == name, position) if code is None else code.when(status == name, position)
    return F.get(F.array(*[F.lit(n) for n in names]), F.max(code) - 1)


def _energy(sample_seconds: float, row_wise_limit: bool, profile: TelemetryProfile) -> list[Column]:
    limit = F.col("grid_limit_kw")
    if row_wise_limit:
        limit = F.least("expected_available_kw", "grid_limit_kw")

    def mwh(kw: Column) -> Column:
        return F.sum(kw * F.lit(float(sample_seconds)) / 3600.0) / 1000.0

    return [
        _curtailment_status(profile).alias("curtailment_status"),
        F.count("*").alias("sample_count"),
        mwh(F.col("measured_generation_kw")).alias("actual_generation_mwh"),
        mwh(F.col("expected_available_kw")).alias("expected_available_mwh"),
        mwh(limit).alias("grid_limited_mwh"),
    ]


def hourly_energy(
    silver: DataFrame, sample_seconds: float = fv.SAMPLE_SECONDS, row_wise_limit: bool = False,
    profile: TelemetryProfile = METERED,
) -> DataFrame:
    """MWh per asset and hour. ``row_wise_limit`` caps the limit at the expected power per sample."""
    return silver.groupBy("reconciliation_hour_utc", "asset_id").agg(
        *_energy(sample_seconds, row_wise_limit, profile)
    )


def bucket_energy(
    silver: DataFrame, width: str = "5 minutes", sample_seconds: float = fv.SAMPLE_SECONDS,
    profile: TelemetryProfile = METERED,
) -> DataFrame:
    """MWh per asset and tumbling interval; also valid on a stream with a watermark."""
    return (
        silver.groupBy(F.window("event_ts_utc", width).alias("w"), "asset_id")
        .agg(*_energy(sample_seconds, False, profile))
        .select(
            F.col("w.start").alias("bucket_start_utc"), F.col("w.end").alias("bucket_end_utc"),
            "asset_id", "curtailment_status", "sample_count",
            "actual_generation_mwh", "expected_available_mwh", "grid_limited_mwh",
        )
    )


def curtailment_episodes(
    silver: DataFrame, gap_seconds: int, sample_seconds: float = fv.SAMPLE_SECONDS
) -> DataFrame:
    """Runs of curtailed samples per asset, broken where the pause exceeds the gap.

    Runs are first formed inside (asset, day), so a hot asset is spread over its
    days, and written as summaries (start, end, count, energy) that can be
    merged. Only the first and last run of a day can touch a neighbour day;
    just those are merged per asset, the others are final.
    """
    curtailed = silver.filter(is_curtailed("operating_status")).select(
        "asset_id",
        "event_ts_utc",
        F.to_date("event_ts_utc").alias("_day"),
        kw_to_mwh(F.col("expected_available_kw") - F.col("measured_generation_kw"), sample_seconds).alias("_mwh"),
    )
    in_day = W.partitionBy("asset_id", "_day").orderBy("event_ts_utc")
    pause = seconds_between(F.lag("event_ts_utc").over(in_day), "event_ts_utc")
    runs = (
        curtailed.withColumn("_new", F.coalesce((pause > gap_seconds).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(in_day.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("asset_id", "_day", "_run")
        .agg(
            F.min("event_ts_utc").alias("start_utc"),
            F.max("event_ts_utc").alias("end_utc"),
            F.count("*").alias("sample_count"),
            F.sum("_mwh").alias("curtailed_mwh"),
        )
        .withColumn("_last", F.max("_run").over(W.partitionBy("asset_id", "_day")))
    )
    runs = materialize(runs, "runs")
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    columns = ["asset_id", "start_utc", "end_utc", "sample_count", "curtailed_mwh"]

    # At most two rows per asset and day reach this window.
    by_asset = W.partitionBy("asset_id").orderBy("start_utc")
    pause = seconds_between(F.lag("end_utc").over(by_asset), "start_utc")
    joined = (
        runs.filter(edge)
        .withColumn("_new", F.coalesce((pause > gap_seconds).cast("int"), F.lit(1)))
        .withColumn("_episode", F.sum("_new").over(by_asset.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("asset_id", "_episode")
        .agg(
            F.min("start_utc").alias("start_utc"),
            F.max("end_utc").alias("end_utc"),
            F.sum("sample_count").alias("sample_count"),
            F.sum("curtailed_mwh").alias("curtailed_mwh"),
        )
    )
    return joined.select(*columns).unionByName(runs.filter(~edge).select(*columns))


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(time) / seconds)


def _level(notices: DataFrame) -> DataFrame:
    long = F.unix_seconds("end_time_utc") - F.unix_seconds("start_time_utc") > FINE_LIMIT * FINE_SECONDS
    return notices.withColumn("_level", F.when(F.col("end_time_utc").isNull(), OPEN).when(long, COARSE).otherwise(FINE))


def notice_index(notices: DataFrame) -> DataFrame:
    """Index rows ``asset_id, _level, _bucket`` of every notice; end excluded.

    A notice of at most two days has a row for each hour it touches, a longer
    one a row for each 30 days, one without an end a single row for its asset.
    So a notice of any length has at most 49 fine rows or one row per coarse
    bucket.
    """
    last = F.col("end_time_utc") - F.expr("interval 1 microsecond")

    def touched(seconds: int) -> Column:
        return F.sequence(_bucket(F.col("start_time_utc"), seconds), _bucket(last, seconds))

    level = F.col("_level")
    buckets = F.when(level == FINE, touched(FINE_SECONDS)).when(level == COARSE, touched(COARSE_SECONDS)).otherwise(
        F.array(F.lit(0).cast("long")))
    some = notices.filter(F.col("start_time_utc").isNotNull()).filter("end_time_utc IS NULL OR start_time_utc < end_time_utc")
    return _level(some).withColumn("_bucket", F.explode(buckets))


def match_notices(silver: DataFrame, notices: DataFrame, open_until: str | None = None) -> DataFrame:
    """Samples inside a notice of their asset, start included, end excluded.

    A notice without an end lasts until ``open_until``, or else for good. The
    range condition becomes an equi join on (asset, level, bucket) with an
    index of two widths: samples ask only on levels that some notice is on.
    The index is broadcast if it is small; otherwise a bucket with very many
    samples is split.
    """
    shown = notices.select(
        "notice_id", "asset_id", "start_time_utc",
        F.coalesce("end_time_utc", F.lit(open_until).cast("timestamp")).alias("end_time_utc"),
        F.col("curtailment_reason").alias("notice_reason"))
    # At most three values.
    levels = sorted(_level(shown).agg(F.collect_set("_level")).first()[0])
    asked = {
        FINE: _bucket(F.col("event_ts_utc"), FINE_SECONDS), COARSE: _bucket(F.col("event_ts_utc"), COARSE_SECONDS),
        OPEN: F.lit(0).cast("long")}
    probes = silver.select("*", F.inline(F.array(*[
        F.struct(F.lit(level).alias("_level"), asked[level].alias("_bucket")) for level in levels or [FINE]])))
    spread_by = [c for c in ("event_ts_utc", "event_id", "kafka_offset") if c in silver.columns]
    found = lookup_join(probes, notice_index(shown), ["asset_id", "_level", "_bucket"], spread_by, "inner")
    inside = (F.col("event_ts_utc") >= F.col("start_time_utc")) & (
        F.col("end_time_utc").isNull() | (F.col("event_ts_utc") < F.col("end_time_utc")))
    return found.filter(inside).drop("_level", "_bucket")


def check_notices(notices: DataFrame, tolerance_mwh: float = 0.001) -> DataFrame:
    """Stated notice energy against power difference times duration."""
    hours = seconds_between("start_time_utc", "end_time_utc") / 3600.0
    computed = (F.col("expected_available_mw") - F.col("actual_output_mw")) * hours
    return notices.withColumn("computed_mwh", computed).withColumn(
        "energy_matches", F.abs(F.col("computed_mwh") - F.col("curtailed_mwh")) <= tolerance_mwh
    )
