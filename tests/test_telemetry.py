import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridledger.operators import bronze, energy, gold, quality, silver
from gridledger.profiles import GENERIC, GENERIC_TELEMETRY_SCHEMA, TelemetryProfile

PROFILE = TelemetryProfile(asset_ids=("WIND_1", "SOLAR_1"))


def message(offset, value, key="WIND_1"):
    return (key.encode() if key else None, value.encode(), "telemetry", offset % 2, offset,
            dt.datetime(2026, 6, 23, 10, 0, offset % 60))


def payload(**changes):
    row = dict(timestamp_utc="2026-06-23 10:00:00", asset_id="WIND_1", measured_generation_kw=60000.0,
               expected_available_kw=100000.0, grid_limit_kw=60000.0, operating_status="CURTAILED_BY_ERCOT",
               telemetry_quality="VALID", source_system="scada")
    return json.dumps(row | changes)


CASES = [
    (payload(), None),
    (payload(timestamp_utc="23/06/2026"), "INVALID_TIMESTAMP"),
    (payload(asset_id=None), "MISSING_ASSET"),
    (payload(asset_id="OTHER"), "UNKNOWN_ASSET"),
    (payload(measured_generation_kw=-1.0), "NEGATIVE_GENERATION"),
    (payload(expected_available_kw=-1.0), "NEGATIVE_EXPECTED_BASELINE"),
    (payload(grid_limit_kw=-1.0), "NEGATIVE_GRID_LIMIT"),
    (payload(operating_status="BROKEN"), "UNKNOWN_STATUS"),
    (payload(telemetry_quality="CORRUPT_SENSOR_VALUE"), "CORRUPT_SENSOR_VALUE"),
    ("{not json", "INVALID_TIMESTAMP"),
    (payload(measured_generation_kw=None), None),
    (payload(operating_status=None), None),
    (payload(telemetry_quality=None), None),
    (payload(asset_id="OTHER", measured_generation_kw=-1.0), "UNKNOWN_ASSET"),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [message(i, body) for i, (body, _) in enumerate(CASES)]
    schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
    return bronze.to_bronze(spark.createDataFrame(rows, schema))


def test_codes_follow_the_first_broken_rule(raw):
    rows = silver.validate(raw, PROFILE).orderBy("kafka_offset").collect()
    assert [r.validation_error_code for r in rows] == [code for _, code in CASES]


def test_raw_payload_survives_and_ids_differ(raw):
    rows = raw.orderBy("kafka_offset").collect()
    assert rows[9].raw_payload == "{not json" and rows[9].asset_id is None
    assert len({r.event_id for r in rows}) == len(CASES)


def test_event_id_is_the_hash_of_the_joined_parts(raw):
    import hashlib

    first = raw.filter("kafka_offset = 0").first()
    assert first.event_id == hashlib.sha256(b"WIND_1|2026-06-23 10:00:00|0|0").hexdigest()


def test_split_is_whole_and_null_assets_are_quarantined(raw):
    rows = silver.validate(raw, PROFILE)
    valid, bad = silver.silver_valid(rows), silver.silver_quarantine(rows)
    assert valid.count() + bad.count() == raw.count()
    assert quality.partition_difference(raw, valid, bad, "event_id").count() == 0
    assert bad.filter("asset_id IS NULL").count() == 2 and valid.filter("asset_id IS NULL").count() == 0


def test_lost_rows_are_found(raw):
    rows = silver.validate(raw, PROFILE)
    difference = quality.partition_difference(raw, silver.silver_valid(rows), raw.limit(0), "event_id")
    assert {r.side for r in difference.collect()} == {"lost"}


def test_strict_profile_reports_missing_values(raw):
    strict = TelemetryProfile(asset_ids=PROFILE.asset_ids, strict=True)
    rows = silver.validate(raw, strict).orderBy("kafka_offset").collect()
    assert [rows[i].validation_error_code for i in (10, 11, 12)] == [
        "MISSING_MEASURED_GENERATION_KW", "MISSING_OPERATING_STATUS", "MISSING_TELEMETRY_QUALITY"]


def test_every_broken_rule_is_listed(raw):
    rows = silver.explain_failures(raw, PROFILE).orderBy("kafka_offset").collect()
    assert rows[13].dq_error_reason == "UNKNOWN_ASSET;NEGATIVE_GENERATION"
    assert rows[0].dq_status == "VALID" and rows[0].dq_error_reason is None


def test_registry_as_table_equals_the_list(spark, raw):
    known = spark.createDataFrame([("WIND_1",), ("SOLAR_1",)], "asset_id string")
    by_table = silver.validate(raw, known_assets=known).select("kafka_offset", "validation_error_code")
    by_list = silver.validate(raw, PROFILE).select("kafka_offset", "validation_error_code")
    assert by_table.exceptAll(by_list).count() == 0


def test_generic_payload(spark):
    body = json.dumps(dict(
        event_id="e1", timestamp_utc="2026-06-23T10:00:00.250000+00:00", asset_id="WIND_1", expected_available_kw=5.0,
        actual_generation_kw=2.0, operating_status="CURTAILED_BY_ISO", curtailment_reason="CONGESTION", nameplate_mw=80))
    schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
    rows = bronze.to_bronze(spark.createDataFrame([message(0, body)], schema), GENERIC_TELEMETRY_SCHEMA)
    row = silver.validate(rows, GENERIC).first()
    assert row.event_id == "e1" and row.validation_error_code is None and row.measured_generation_kw == 2.0
    assert row.event_ts_utc == dt.datetime(2026, 6, 23, 10, 0, 0, 250000)


def test_incremental_keeps_the_window_and_full_refresh_keeps_all(spark):
    now = dt.datetime(2026, 6, 23, 12)
    rows = spark.createDataFrame([(now - dt.timedelta(hours=h),) for h in (1, 72, 73)], "at timestamp")
    assert silver.incremental(rows, "at", now).count() == 2
    assert silver.incremental(rows, "at", now, full_refresh=True).count() == 3
    assert silver.incremental(rows, "at", F.lit(now)).count() == 2


def samples(spark, rows):
    """rows: (asset, seconds after ten, measured, expected, limit, status)."""
    start = dt.datetime(2026, 6, 23, 10)
    return spark.createDataFrame(
        [(a, start + dt.timedelta(seconds=s), start + dt.timedelta(hours=s // 3600), m, e, lim, st) for a, s, m, e, lim, st in rows],
        "asset_id string, event_ts_utc timestamp, reconciliation_hour_utc timestamp, measured_generation_kw double, "
        "expected_available_kw double, grid_limit_kw double, operating_status string",
    )


def test_one_hour_of_ten_second_samples(spark):
    """100 MW available, 60 MW accepted: 60 MWh delivered, 40 MWh lost."""
    rows = [("WIND_1", s, 60000.0, 100000.0, 60000.0, "CURTAILED_BY_ERCOT") for s in range(0, 3600, 10)]
    row = energy.hourly_energy(samples(spark, rows)).first()
    assert row.sample_count == 360 and row.curtailment_status == "CURTAILED_BY_ERCOT"
    assert row.actual_generation_mwh == pytest.approx(60) and row.expected_available_mwh == pytest.approx(100)
    assert row.grid_limited_mwh == pytest.approx(60)


def test_two_sided_settlement_example(spark):
    row = spark.createDataFrame(
        [(60.0, 30.0, 40.0, 40.0)],
        "actual_generation_mwh double, market_price_usd_per_mwh double, contract_rate_per_mwh double, eligible_compensable_mwh double",
    )
    out = gold.two_sided_settlement(row).first()
    assert (out.market_revenue_usd, out.contract_difference_usd, out.total_revenue_usd, out.potential_compensation_usd) == (
        1800.0, 600.0, 2400.0, 1600.0)


def test_limit_above_expected_differs_by_mode(spark):
    rows = samples(spark, [("W", 0, 1.0, 3600.0, 7200.0, "NORMAL"), ("W", 10, 1.0, 3600.0, 1800.0, "NORMAL")])
    assert energy.hourly_energy(rows).first().grid_limited_mwh == pytest.approx(0.025)
    assert energy.hourly_energy(rows, row_wise_limit=True).first().grid_limited_mwh == pytest.approx(0.015)


def test_status_maximum_matches_text_order(spark):
    rows = samples(spark, [("W", 0, 1.0, 1.0, 1.0, "CURTAILED_BY_PJM"), ("W", 10, 1.0, 1.0, 1.0, "CURTAILED_BY_CAISO"),
                           ("S", 0, 1.0, 1.0, 1.0, "NORMAL")])
    out = {r.asset_id: r.curtailment_status for r in energy.hourly_energy(rows).collect()}
    assert out == {"W": "CURTAILED_BY_PJM", "S": None}


def test_notice_energy(spark):
    start = dt.datetime(2026, 6, 23, 19, 5)
    rows = spark.createDataFrame(
        [("N1", start, start + dt.timedelta(minutes=35), 72.4, 42.1, 17.675), ("N2", start, start + dt.timedelta(minutes=35), 72.4, 42.1, 18.0)],
        "notice_id string, start_time_utc timestamp, end_time_utc timestamp, expected_available_mw double, actual_output_mw double, curtailed_mwh double",
    )
    out = {r.notice_id: r for r in energy.check_notices(rows).collect()}
    assert out["N1"].computed_mwh == pytest.approx(17.675) and out["N1"].energy_matches and not out["N2"].energy_matches


def test_notice_bounds_include_start_and_exclude_end(spark):
    rows = samples(spark, [("W", s, 1.0, 1.0, 1.0, "NORMAL") for s in (3590, 3600, 7200, 10799, 10800)])
    start = dt.datetime(2026, 6, 23, 11)
    notice = spark.createDataFrame(
        [("N", "W", start, start + dt.timedelta(hours=2), "CONGESTION"), ("EMPTY", "W", start, start, "CONGESTION")],
        "notice_id string, asset_id string, start_time_utc timestamp, end_time_utc timestamp, curtailment_reason string",
    )
    times = sorted(r.event_ts_utc for r in energy.match_notices(rows, notice).collect())
    assert times == [start, start + dt.timedelta(hours=1), start + dt.timedelta(seconds=7199)]


def test_episodes_join_across_midnight_and_break_at_the_gap(spark):
    late = 14 * 3600  # midnight is 14 hours after ten
    marks = [late - 30, late - 20, late + 10, late + 1000, late + 1010]
    rows = samples(spark, [("W", s, 0.0, 3600.0, 0.0, "CURTAILED_BY_PJM") for s in marks])
    out = energy.curtailment_episodes(rows, 60).orderBy("start_utc").collect()
    assert [r.sample_count for r in out] == [3, 2]
    assert out[0].curtailed_mwh == pytest.approx(0.03)


def test_episodes_equal_a_single_pass(spark):
    import random

    random.seed(5)
    rows = samples(spark, [
        (random.choice("HHHAB"), random.randrange(0, 5 * 86400), 1.0, 2.0, 1.0, random.choice(["CURTAILED_BY_PJM", "NORMAL"]))
        for _ in range(3000)
    ])
    expected = {}
    for asset in "HAB":
        times = sorted(r.event_ts_utc for r in rows.filter(f"asset_id = '{asset}' AND operating_status <> 'NORMAL'").collect())
        runs = [[times[0]]]
        for a, b in zip(times, times[1:]):
            if (b - a).total_seconds() > 900:
                runs.append([])
            runs[-1].append(b)
        expected[asset] = [(r[0], r[-1], len(r)) for r in runs]
    got = {a: [] for a in "HAB"}
    for r in energy.curtailment_episodes(rows, 900).orderBy("start_utc").collect():
        got[r.asset_id].append((r.start_utc, r.end_utc, r.sample_count))
    assert got == expected


def test_latest_and_first_of_a_hot_key(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id",
        F.lit("x").alias("text"),
    )
    assert silver.latest(rows, ["key"], ["id"]).filter("key = 'hot'").first().id == 29997
    assert silver.dedupe_events(rows, ["key"], ["id"]).filter("key = 'hot'").first().id == 0
    assert silver.latest(rows, ["key"], ["id"]).count() == 20001


def test_gate_blocks_and_reports(spark):
    rows = spark.createDataFrame([(1, -1.0, "A"), (1, 2.0, "B"), (None, 3.0, "X")], "id int, v double, s string")
    checks = [quality.row_count_positive(), quality.not_missing("id"), quality.unique("id"), quality.non_negative("v"),
              quality.accepted("s", ["A", "B"]), quality.no_rows("never", F.col("v") > 100)]
    results = quality.run_checks(rows, "t", checks)
    failed = {r.check_name: r.failed_count for r in results.filter("NOT passed").collect()}
    assert failed == {"missing_count(id) = 0": 1, "duplicate_count(id) = 0": 1, "v must be non-negative": 1, "s has accepted values": 1}
    assert quality.gate(results).first().dq_gate_status == "FAILED"
    with pytest.raises(quality.QualityGateError, match="missing_count"):
        quality.require_passed(results)
    assert quality.gate_status(results, "t") == "FAILED" and quality.gate_status(results, "unchecked") == "FAILED"
    quality.require_passed(quality.run_checks(rows, "t", [quality.row_count_positive()]))
    with pytest.raises(ValueError):
        quality.checks_from_spec([{"unknown": 1}])


def test_row_count_check_fails_on_empty(spark):
    empty = spark.createDataFrame([], "id int")
    assert not quality.run_checks(empty, "t", [quality.row_count_positive()]).first().passed


def test_open_notices_last_until_the_bound(spark):
    from pyspark.sql import functions as F

    from gridledger.operators import energy

    rows = spark.range(5).select(
        F.lit("A").alias("asset_id"), F.expr("timestamp'2026-06-01 00:30:00' + make_interval(0, 0, 0, 0, int(id))").alias("event_ts_utc")
    ).withColumn("reconciliation_hour_utc", F.date_trunc("hour", "event_ts_utc"))
    notice = spark.sql(
        "SELECT 'n' AS notice_id, 'A' AS asset_id, timestamp'2026-06-01 01:00:00' AS start_time_utc, "
        "cast(NULL AS timestamp) AS end_time_utc, 'r' AS curtailment_reason")
    assert energy.match_notices(rows, notice).count() == 4
    assert energy.match_notices(rows, notice, "2026-06-01 03:00:00").count() == 2


NOTICE = "notice_id string, asset_id string, start_time_utc timestamp, end_time_utc timestamp, curtailment_reason string"


def test_a_long_notice_has_few_index_rows(spark):
    start = dt.datetime(2016, 3, 7, 10, 20)
    lengths = {"minutes": dt.timedelta(minutes=50), "two days": dt.timedelta(days=2), "ten years": dt.timedelta(days=3652), "open": None}
    rows = [(name, "W", start, length and start + length, "r") for name, length in lengths.items()] + [("none", "W", start, start, "r"), ("null", "W", None, None, "r")]
    counted = {r.notice_id: r["count"] for r in energy.notice_index(spark.createDataFrame(rows, NOTICE)).groupBy("notice_id").count().collect()}
    assert counted["minutes"] <= 2 and counted["two days"] == 49 and counted["open"] == 1
    assert counted["ten years"] <= 3652 / 30 + 2 and counted.keys() == lengths.keys()


def test_notices_of_all_lengths_match_as_a_plain_join_does(spark):
    import random

    r = random.Random(9)
    rows = samples(spark, [
        ("hot" if i % 3 == 0 else r.choice("ABC"), r.randrange(-40 * 86400, 40 * 86400), 1.0, 2.0, 1.0, "NORMAL") for i in range(1500)])
    day = dt.datetime(2026, 6, 23)
    notices = [("long", "hot", day - dt.timedelta(days=30), day + dt.timedelta(days=3622), "r"), ("open", "A", day, None, "r")]
    for i in range(60):
        start = day + dt.timedelta(minutes=r.randrange(-40 * 1440, 40 * 1440))
        notices.append((f"n{i}", r.choice(["hot", "A", "B", None]), start, start + dt.timedelta(minutes=r.choice([0, 5, 61, 1440, 5000, 60000])), "r"))
    table = spark.createDataFrame(notices, NOTICE)
    got = sorted((x.event_ts_utc, x.notice_id) for x in energy.match_notices(rows, table).collect())
    expected = sorted(
        (s.event_ts_utc, n[0]) for s in rows.collect() for n in notices
        if s.asset_id == n[1] and n[2] <= s.event_ts_utc and (n[3] is None or s.event_ts_utc < n[3]))
    assert got == expected and {"long", "open"} <= {n for _, n in got}
    assert energy.match_notices(rows, table.limit(0)).count() == 0


def test_picks_in_two_phases_equal_the_plain_ones(spark):
    import random

    from pyspark.sql import functions as F

    from gridledger.operators import silver

    r = random.Random(2)
    rows = spark.createDataFrame(
        [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, 1, 2, 3, 3]), i, f"s{i}") for i in range(500)],
        "key string, at int, n int, status string")
    for two, one in ((silver.latest_of_many, silver.latest), (silver.first_of_many, silver.dedupe_events)):
        for order in (["at", "n"], ["n"], ["status"]):
            assert sorted(map(str, two(rows, ["key"], order).collect())) == sorted(map(str, one(rows, ["key"], order).collect()))
    many = silver._pick_in_two(rows, ["n"], ["at"], F.max_by, max_keys=10)
    assert many.count() == 500
