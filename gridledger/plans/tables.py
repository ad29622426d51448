"""The domain tables, projected from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.functions.scalars import hash_key, hour_of, time_text
from gridledger.operators import energy, gold, silver
from gridledger.plans.registry import part
from gridledger.session import materialize

# The given events are spaced like hourly readings.
SAMPLE_SECONDS = 3600
FIRST_DAY = "2024-01-01"


_SCHEMAS: dict[tuple[str, int], T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once, and again when they have been replaced."""
    path = f"{sf_dir}/{name}.parquet"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder)
    known = path, status.getModificationTime()
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _contract(key: str) -> Column:
    return F.concat(F.lit("src"), (F.col(key) % 20).cast("string"))


def _day(key: str, days: int = 30) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col(key) % days).cast("int"))


# --- telemetry -------------------------------------------------------------

def telemetry_fields(events: DataFrame) -> DataFrame:
    """Payload columns of the given events; ``k`` of the properties marks the bad records."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(F.col("event_type").isin("view", "click"), "NORMAL")
        .when(F.col("event_type") == "purchase", "CURTAILED_BY_ERCOT")
        .when(F.col("event_type") == "signup", "NIGHT_REST")
        .otherwise("UNKNOWN")
    )
    eid, value = F.col("event_id"), F.col("value")
    return events.withColumn("k", k).select(
        "event_id", "ts", "k", "event_type", "user_id",
        F.when(F.col("k") == 2, "not-a-time").otherwise(time_text("ts")).alias("timestamp_utc"),
        F.when(F.col("k") != 3, _id("A", "user_id")).alias("asset_id"),
        F.when(F.col("k") == 1, -value * 1000).when(F.col("k") != 4, value * 1000).alias("measured_generation_kw"),
        ((value + eid % 7) * 1000).alias("expected_available_kw"),
        ((value + eid % 7 - eid % 5 * 5) * 1000).alias("grid_limit_kw"),
        status.alias("operating_status"),
        F.when(F.col("k") == 0, "CORRUPT_SENSOR_VALUE").when(F.col("k") != 5, "VALID").alias("telemetry_quality"),
        F.lit("scada").alias("source_system"),
    )


def bronze_from(events: DataFrame) -> DataFrame:
    f = telemetry_fields(events)
    partition = (F.col("event_id") % 2).cast("int")
    return f.select(
        hash_key("asset_id", "timestamp_utc", partition, "event_id").alias("event_id"),
        "timestamp_utc", "asset_id", "measured_generation_kw", "expected_available_kw", "grid_limit_kw",
        "operating_status", "telemetry_quality", "source_system",
        F.concat(F.lit("payload "), F.col("event_id").cast("string")).alias("raw_payload"),
        F.lit("telemetry").alias("kafka_topic"),
        partition.alias("kafka_partition"),
        F.col("event_id").alias("kafka_offset"),
        F.col("ts").cast("timestamp").alias("kafka_timestamp"),
        (F.date_trunc("second", "ts") + F.make_dt_interval(secs=(F.col("event_id") % 3600).cast("decimal(18,6)"))).alias(
            "bronze_ingested_at"
        ),
    )


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_from(read(spark, sf_dir, "events"))


def messages_from(events: DataFrame) -> DataFrame:
    """Broker records of the given events; a marked record has a cut payload."""
    f = telemetry_fields(events)

    def pair(name: str, quoted: bool) -> Column:
        text = F.col(name).cast("string")
        shown = F.concat(F.lit('"'), text, F.lit('"')) if quoted else text
        return F.concat(F.lit(f'"{name}":'), F.coalesce(shown, F.lit("null")))

    body = F.concat(F.lit("{"), F.concat_ws(
        ",", pair("timestamp_utc", True), pair("asset_id", True), pair("measured_generation_kw", False),
        pair("expected_available_kw", False), pair("grid_limit_kw", False), pair("operating_status", True),
        pair("telemetry_quality", True), pair("source_system", True)), F.lit("}"))
    return f.select(
        F.col("asset_id").cast("binary").alias("key"),
        F.when(F.col("k") == 6, F.lit("{broken")).otherwise(body).cast("binary").alias("value"),
        F.lit("telemetry").alias("topic"),
        (F.col("event_id") % 2).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(read(spark, sf_dir, "events"))


def generic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic_messages_from(read(spark, sf_dir, "events"))


def generic_messages_from(events: DataFrame) -> DataFrame:
    """The given events in the second payload: ISO times, no quality mark, its own id."""
    value = F.col("value").cast("string")
    curtailed = F.col("event_type") == "purchase"
    body = F.concat(
        F.lit('{"event_id":"g'), F.col("event_id").cast("string"),
        F.lit('","event_type":"scada.telemetry","timestamp_utc":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit('+00:00","asset_id":"A'), F.col("user_id").cast("string"), F.lit('","actual_generation_kw":'),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("-"), value)).otherwise(value),
        F.lit(',"expected_available_kw":500.0,"operating_status":"'),
        F.when(curtailed, "CURTAILED_BY_ISO").when(F.col("event_type") == "error", "FAULT").otherwise("NORMAL"),
        F.lit('","curtailment_reason":'), F.when(curtailed, '"CONGESTION"').otherwise("null"), F.lit("}"),
    )
    return events.select(
        F.col("user_id").cast("string").cast("binary").alias("key"), body.cast("binary").alias("value"),
        F.lit("telemetry").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


part("fields", """
SELECT event_id AS eid, ts, k, event_type, user_id,
  CASE WHEN k = 2 THEN 'not-a-time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp_utc,
  CASE WHEN k <> 3 THEN 'A' || user_id END AS asset_id,
  CASE WHEN k = 1 THEN -value * 1000 WHEN k <> 4 THEN value * 1000 END AS measured_generation_kw,
  (value + event_id % 7) * 1000 AS expected_available_kw,
  (value + event_id % 7 - event_id % 5 * 5) * 1000 AS grid_limit_kw,
  CASE WHEN event_type IN ('view', 'click') THEN 'NORMAL' WHEN event_type = 'purchase' THEN 'CURTAILED_BY_ERCOT'
       WHEN event_type = 'signup' THEN 'NIGHT_REST' ELSE 'UNKNOWN' END AS operating_status,
  CASE WHEN k = 0 THEN 'CORRUPT_SENSOR_VALUE' WHEN k <> 5 THEN 'VALID' END AS telemetry_quality,
  'scada' AS source_system
FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)
""")

part("bronze", """
SELECT sha256(concat_ws('|', asset_id, timestamp_utc, eid % 2, eid)) AS event_id, timestamp_utc, asset_id,
  measured_generation_kw, expected_available_kw, grid_limit_kw, operating_status, telemetry_quality, source_system,
  'payload ' || eid AS raw_payload, 'telemetry' AS kafka_topic, CAST(eid % 2 AS INTEGER) AS kafka_partition,
  eid AS kafka_offset, ts AS kafka_timestamp, date_trunc('second', ts) + to_seconds(eid % 3600) AS bronze_ingested_at
FROM fields
""", ["fields"])


def known_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets telemetry may come from: accounts that are not overdrawn."""
    return read(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0).select(_id("A", "c_custkey").alias("asset_id"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.validate(bronze(spark, sf_dir), known_assets=known_assets(spark, sf_dir))


def silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_valid(validated(spark, sf_dir))


part("typed", """
SELECT b.*, try_strptime(b.timestamp_utc, '%Y-%m-%d %H:%M:%S') AS event_ts_utc,
  b.asset_id IS NOT NULL AND c.c_custkey IS NOT NULL AS listed
FROM bronze b LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON b.asset_id = 'A' || c.c_custkey
""", ["bronze"])

part("validated", """
SELECT *, CASE
  WHEN event_ts_utc IS NULL THEN 'INVALID_TIMESTAMP'
  WHEN asset_id IS NULL THEN 'MISSING_ASSET'
  WHEN NOT listed THEN 'UNKNOWN_ASSET'
  WHEN measured_generation_kw < 0 THEN 'NEGATIVE_GENERATION'
  WHEN expected_available_kw < 0 THEN 'NEGATIVE_EXPECTED_BASELINE'
  WHEN grid_limit_kw < 0 THEN 'NEGATIVE_GRID_LIMIT'
  WHEN operating_status NOT IN ('NORMAL', 'CURTAILED_BY_ERCOT', 'CURTAILED_BY_CAISO', 'CURTAILED_BY_PJM', 'NIGHT_REST')
    THEN 'UNKNOWN_STATUS'
  WHEN telemetry_quality <> 'VALID' THEN telemetry_quality END AS code
FROM typed
""", ["typed"])

part("silver", """
SELECT *, date_trunc('hour', event_ts_utc) AS hour_utc FROM validated WHERE asset_id IS NOT NULL AND code IS NULL
""", ["validated"])


# --- dimensions and market facts -------------------------------------------

def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    kind = F.element_at(F.array(F.lit("WIND"), F.lit("SOLAR"), F.lit("STORAGE")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _id("A", "c_custkey").alias("asset_id"), F.col("c_name").alias("equip_name"), kind.alias("asset_type"),
            F.col("c_acctbal").alias("rated_capacity_mw"), F.col("r_name").alias("iso_region"),
        )
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract terms per site; one market segment sells without a contract."""
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "MACHINERY").select(
        _id("ACC", "c_custkey").alias("account_id"),
        _id("Offtaker ", "c_nationkey").alias("oftaker_name"),
        _contract("c_custkey").alias("associated_ppa_id"),
        _id("A", "c_custkey").alias("site_identity_tag"),
        (key % 20 + 30).cast("double").alias("contract_rate_per_mwh"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "N").otherwise("Y").alias("curtailment_compensable_flag"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "ENERGY_ONLY").otherwise("FIXED_PPA_RATE").alias("settlement_method"),
    )


def _reason() -> Column:
    names = F.array(F.lit("CONGESTION"), F.lit("TRANSMISSION_CONSTRAINT"), F.lit("NEGATIVE_PRICE"))
    return F.element_at(names, (F.col("user_id") % 3 + 1).cast("int"))


def curtailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market event per curtailed reading, so an asset-hour may have several."""
    return read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("CURT"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("curtailment_event_id"),
        _id("A", "user_id").alias("asset_id"),
        time_text(hour_of("ts")).alias("reconciliation_hour_utc"),
        _reason().alias("curtailment_reason"),
        (F.col("value") / 2).alias("iso_limit_mw"),
    )


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the market paid: signups stand for paid hours, plus half of the curtailed ones."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        read(spark, sf_dir, "events")
        .filter((F.col("event_type") == "signup") | ((F.col("event_type") == "purchase") & (k >= 50)))
        .select(
            _id("A", "user_id").alias("asset_id"), _contract("user_id").alias("associated_ppa_id"),
            time_text(hour_of("ts")).alias("reconciliation_hour_utc"), F.col("value").alias("actual_settlement_usd"),
        )
    )


part("assets", """
SELECT 'A' || c_custkey AS asset_id, c_name AS equip_name,
  CASE c_nationkey % 3 WHEN 0 THEN 'WIND' WHEN 1 THEN 'SOLAR' ELSE 'STORAGE' END AS asset_type,
  c_acctbal AS rated_capacity_mw, r_name AS iso_region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

part("contracts", """
SELECT 'ACC' || c_custkey AS account_id, 'Offtaker ' || c_nationkey AS oftaker_name,
  'src' || (c_custkey % 20) AS associated_ppa_id, 'A' || c_custkey AS site_identity_tag,
  CAST(30 + c_custkey % 20 AS DOUBLE) AS contract_rate_per_mwh,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'N' ELSE 'Y' END AS curtailment_compensable_flag,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'ENERGY_ONLY' ELSE 'FIXED_PPA_RATE' END AS settlement_method
FROM customer WHERE c_mktsegment <> 'MACHINERY'
""")

part("curtailment", """
SELECT 'CURT' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS curtailment_event_id, 'A' || user_id AS asset_id,
  date_trunc('hour', ts) AS hour_utc,
  CASE user_id % 3 WHEN 0 THEN 'CONGESTION' WHEN 1 THEN 'TRANSMISSION_CONSTRAINT' ELSE 'NEGATIVE_PRICE' END AS reason
FROM events WHERE event_type = 'purchase'
""")

part("first_curtailment", """
SELECT asset_id, hour_utc, min(curtailment_event_id) AS curtailment_event_id, min(reason) AS curtailment_reason
FROM curtailment GROUP BY 1, 2
""", ["curtailment"])

part("paid", """
SELECT asset_id, ppa, hour_utc, sum(usd) AS usd FROM (
  SELECT 'A' || user_id AS asset_id, 'src' || (user_id % 20) AS ppa, date_trunc('hour', ts) AS hour_utc, value AS usd
  FROM events WHERE event_type = 'signup'
     OR (event_type = 'purchase' AND CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) >= 50))
GROUP BY 1, 2, 3
""")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.hourly_energy(silver_rows(spark, sf_dir), SAMPLE_SECONDS)


def gold_dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "assets": assets(spark, sf_dir), "contracts": contracts(spark, sf_dir),
        "curtailment": curtailment(spark, sf_dir), "settlements": settlements(spark, sf_dir),
    }


def gold_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.build_gold(hourly(spark, sf_dir), **gold_dims(spark, sf_dir))


def stored_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leakage fact as a written table, for steps that read it more than once."""
    return materialize(gold_fact(spark, sf_dir), "gold")


part("hourly", """
SELECT hour_utc, asset_id,
  max(CASE WHEN operating_status LIKE 'CURTAILED_BY_%' THEN operating_status END) AS curtailment_status,
  count(*) AS sample_count,
  sum(measured_generation_kw * 3600.0 / 3600.0) / 1000.0 AS actual_mwh,
  sum(expected_available_kw * 3600.0 / 3600.0) / 1000.0 AS expected_mwh,
  sum(grid_limit_kw * 3600.0 / 3600.0) / 1000.0 AS limited_mwh
FROM silver GROUP BY 1, 2
""", ["silver"])

part("joined", """
SELECT h.*, a.equip_name, a.asset_type, a.iso_region, c.account_id, c.oftaker_name, c.associated_ppa_id,
  c.contract_rate_per_mwh, c.curtailment_compensable_flag, c.settlement_method,
  e.curtailment_event_id, e.curtailment_reason,
  greatest(h.expected_mwh - h.actual_mwh, 0.0) AS physical_shortfall_mwh,
  CASE WHEN e.curtailment_event_id IS NOT NULL THEN greatest(h.expected_mwh - h.limited_mwh, 0.0) ELSE 0.0 END
    AS grid_curtailment_mwh,
  coalesce(p.usd, 0.0) AS actual_settlement_usd
FROM hourly h JOIN assets a USING (asset_id) JOIN contracts c ON c.site_identity_tag = h.asset_id
LEFT JOIN first_curtailment e ON e.asset_id = h.asset_id AND e.hour_utc = h.hour_utc
LEFT JOIN paid p ON p.asset_id = h.asset_id AND p.ppa = c.associated_ppa_id AND p.hour_utc = h.hour_utc
""", ["hourly", "assets", "contracts", "first_curtailment", "paid"])

part("gold", """
SELECT *, greatest(expected_settlement_usd - actual_settlement_usd, 0.0) AS leakage_usd,
  sha256(strftime(hour_utc, '%Y-%m-%d %H:%M:%S') || '|' || asset_id || '|' || associated_ppa_id) AS fact_record_hash
FROM (
  SELECT *, eligible_mwh * contract_rate_per_mwh AS expected_settlement_usd FROM (
    SELECT *, CASE WHEN curtailment_compensable_flag = 'Y' AND curtailment_event_id IS NOT NULL
                   THEN grid_curtailment_mwh ELSE 0.0 END AS eligible_mwh FROM joined))
""", ["joined"])


part("breaches", """
SELECT *, sha256('BREACH|' || fact_record_hash) AS breach_event_id, associated_ppa_id AS contract_id,
  CAST(hour_utc AS DATE) AS market_date,
  CASE WHEN leakage_usd >= 500 THEN 'HIGH' WHEN leakage_usd >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM gold WHERE leakage_usd > 0
""", ["gold"])


def asset_contract_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-reason compensation flags of each contract."""
    return read(spark, sf_dir, "customer").select(
        _id("A", "c_custkey").alias("asset_id"), _contract("c_custkey").alias("contract_id"),
        (F.col("c_custkey") % 20 + 30).cast("decimal(18,2)").alias("contract_rate_usd_per_mwh"),
        (F.col("c_mktsegment") != "HOUSEHOLD").alias("congestion_curtailment_compensable"),
        (F.col("c_mktsegment") != "BUILDING").alias("transmission_constraint_compensable"),
        (F.col("c_mktsegment") == "FURNITURE").alias("negative_price_curtailment_compensable"),
    )


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice per signup reading: it starts then and lasts one to three hours and a part."""
    start = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    minutes = (F.col("event_id") % 200 + 10).cast("int")
    return read(spark, sf_dir, "events").filter(F.col("event_type") == "signup").select(
        _id("N", "event_id").alias("notice_id"), _id("A", "user_id").alias("asset_id"),
        _contract("user_id").alias("related_contract_id"), _reason().alias("curtailment_reason"),
        start.alias("start_time_utc"), (start + F.make_dt_interval(mins=minutes)).alias("end_time_utc"),
        (F.col("value") + 10).alias("expected_available_mw"), F.col("value").alias("actual_output_mw"),
        ((F.col("event_id") % 200 + 10) / 6.0 + F.when(F.col("user_id") % 2 == 0, 0.0).otherwise(0.5)).alias("curtailed_mwh"),
    )


part("notices", """
SELECT 'N' || event_id AS notice_id, 'A' || user_id AS asset_id,
  CASE user_id % 3 WHEN 0 THEN 'CONGESTION' WHEN 1 THEN 'TRANSMISSION_CONSTRAINT' ELSE 'NEGATIVE_PRICE' END AS reason,
  date_trunc('minute', ts) AS start_utc, date_trunc('minute', ts) + to_minutes(event_id % 200 + 10) AS end_utc,
  event_id % 200 + 10 AS minutes, user_id
FROM events WHERE event_type = 'signup'
""")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement statement rows: what the market reports as shortfall per paid reading."""
    return read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "click")).select(
        _id("S", "event_id").alias("statement_id"), _id("A", "user_id").alias("asset_id"),
        _contract("user_id").alias("contract_id"), F.to_date("ts").alias("market_date"),
        F.lit("CURT_SHORTFALL").alias("charge_code"), F.col("value").alias("estimated_leakage_revenue_usd"),
    )


part("statements", """
SELECT 'A' || user_id AS asset_id, 'src' || (user_id % 20) AS contract_id, CAST(ts AS DATE) AS market_date, value AS usd
FROM events WHERE event_type IN ('purchase', 'click')
""")


# --- enterprise extracts ----------------------------------------------------

def invoice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("PARTIALLY_PAID")
    gross = F.col("o_totalprice").cast("decimal(18,2)")
    start = _day("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        _id("INV", "o_orderkey").alias("invoice_id"), _id("CUST", "o_custkey").alias("sap_customer_number"),
        _contract("o_custkey").alias("contract_id"), _id("A", "o_custkey").alias("asset_id"),
        start.alias("invoice_period_start"), F.date_add(start, 2).alias("invoice_period_end"),
        F.date_add(start, 3).alias("invoice_date"), F.date_add(start, 33).alias("due_date"),
        status.alias("invoice_status"), gross.alias("gross_amount_usd"),
        F.when(status == "PAID", F.lit(0).cast("decimal(18,2)")).when(status == "OPEN", gross)
        .otherwise(F.least(gross, F.lit(15000).cast("decimal(18,2)"))).alias("open_amount_usd"),
    ).withColumn("paid_amount_usd", (F.col("gross_amount_usd") - F.col("open_amount_usd")).cast("decimal(18,2)"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _id("INV", "l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_no"),
            _id("A", "o_custkey").alias("asset_id"), _contract("o_custkey").alias("contract_id"),
            _day("l_orderkey").alias("billing_period"),
            F.col("l_quantity").cast("decimal(18,3)").alias("billing_quantity_mwh"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,2)").alias("contract_rate_usd_per_mwh"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("line_amount_usd"),
        )
    )


def gl_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        _id("GL", "o_orderkey").alias("accounting_doc_id"), _id("INV", "o_orderkey").alias("invoice_id"),
        F.lit("400100").alias("gl_account"), _id("PC", "o_orderpriority").alias("profit_center"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice"))
        .cast("decimal(18,2)").alias("amount_usd"),
    )


part("headers", """
SELECT *, CAST(gross - open AS DECIMAL(18,2)) AS paid FROM (
  SELECT 'INV' || o_orderkey AS invoice_id, 'src' || (o_custkey % 20) AS contract_id, 'A' || o_custkey AS asset_id,
    DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS day0,
    CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'OPEN' ELSE 'PARTIALLY_PAID' END AS status,
    CAST(o_totalprice AS DECIMAL(18,2)) AS gross,
    CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN CAST(o_totalprice AS DECIMAL(18,2))
         ELSE least(CAST(o_totalprice AS DECIMAL(18,2)), CAST(15000 AS DECIMAL(18,2))) END AS DECIMAL(18,2)) AS open,
    'GL' || o_orderkey AS accounting_doc_id, '400100' AS gl_account, 'PC' || o_orderpriority AS profit_center,
    CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 1 ELSE o_totalprice END AS DECIMAL(18,2)) AS posted
  FROM orders)
""")

part("lines", """
SELECT 'INV' || l_orderkey AS invoice_id, l_linenumber AS line_no, 'A' || o_custkey AS asset_id,
  'src' || (o_custkey % 20) AS contract_id, DATE '2024-01-01' + CAST(l_orderkey % 30 AS INTEGER) AS billing_period,
  CAST(l_quantity AS DECIMAL(18,3)) AS qty, CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(18,2)) AS rate,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING").select(
        _id("SF", "c_custkey").alias("sf_account_id"), F.col("c_name").alias("account_name"),
        _id("CUST", "c_custkey").alias("sap_customer_number"), F.lit("Active").alias("account_status"),
        F.when(F.col("c_acctbal") < 0, "High").otherwise("Standard").alias("risk_tier"),
    )


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.upper("c_name")).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0).select(
        _id("CUST", "c_custkey").alias("sap_customer_number"), name.alias("business_partner_name"),
        _id("SF", "c_custkey").alias("sf_account_id"),
    )


def crm_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _day("c_custkey", 10)
    return read(spark, sf_dir, "customer").select(
        _id("SFC", "c_custkey").alias("sf_contract_id"), _contract("c_custkey").alias("contract_id"),
        _id("SF", "c_custkey").alias("sf_account_id"), _id("A", "c_custkey").alias("asset_id"),
        _id("Contract ", "c_custkey").alias("contract_name"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "Draft").otherwise("Activated").alias("contract_status"),
        start.alias("start_date"),
        F.when(F.col("c_nationkey") != 0, F.date_add(start, 15)).alias("end_date"),
        (F.col("c_custkey") % 20 + 30).cast("decimal(18,2)").alias("contract_rate_usd_per_mwh"),
    )


def crm_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        _id("SFA", "c_custkey").alias("sf_asset_id"), _id("A", "c_custkey").alias("asset_id")
    )


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    status = (
        F.when(p == "1-URGENT", "Closed - Paid").when(p == "2-HIGH", "Closed - Rejected")
        .when(p == "3-MEDIUM", "In Review").otherwise("Open")
    )
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    created = F.date_add(_day("o_orderkey"), 1)
    return read(spark, sf_dir, "orders").select(
        _id("D", "o_orderkey").alias("sf_dispute_id"), _id("RD-", "o_orderkey").alias("dispute_number"),
        _id("A", "o_custkey").alias("asset_id"), _contract("o_custkey").alias("contract_id"),
        _day("o_orderkey").alias("market_date"), status.alias("status"),
        amount.alias("estimated_dispute_amount_usd"),
        F.when(status == "Closed - Paid", amount).otherwise(F.lit(0).cast("decimal(18,2)")).alias("approved_amount_usd"),
        created.alias("created_date"),
        F.when(status.startswith("Closed"), F.date_add(created, (F.col("o_custkey") % 40).cast("int"))).alias("closed_date"),
    )


part("disputes", """
SELECT 'RD-' || o_orderkey AS dispute_number, 'A' || o_custkey AS asset_id, 'src' || (o_custkey % 20) AS contract_id,
  DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS market_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Closed - Paid' WHEN '2-HIGH' THEN 'Closed - Rejected'
       WHEN '3-MEDIUM' THEN 'In Review' ELSE 'Open' END AS status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS approved,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_custkey % 40 END AS days_open
FROM orders
""")

part("open_disputes", """
SELECT asset_id, contract_id, market_date, min(dispute_number) AS dispute_number, count(*) AS n
FROM disputes WHERE status NOT LIKE 'Closed%' GROUP BY 1, 2, 3
""", ["disputes"])

part("crm_contracts", """
SELECT 'SFC' || c_custkey AS sf_contract_id, 'src' || (c_custkey % 20) AS contract_id, 'SF' || c_custkey AS sf_account_id,
  'A' || c_custkey AS asset_id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Draft' ELSE 'Activated' END AS contract_status,
  DATE '2024-01-01' + CAST(c_custkey % 10 AS INTEGER) AS start_date,
  CASE WHEN c_nationkey <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 10 AS INTEGER) + 15 END AS end_date,
  CAST(30 + c_custkey % 20 AS DECIMAL(18,2)) AS rate
FROM customer
""")

part("billed", """
SELECT asset_id, contract_id, market_date, max_by(b, (day0, invoice_id)) AS b FROM (
  SELECT h.contract_id, l.asset_id, h.day0, h.invoice_id, d.market_date,
    {'invoice_id': h.invoice_id, 'status': h.status, 'mwh': l.mwh, 'usd': l.usd, 'doc': h.accounting_doc_id,
     'gl': h.gl_account, 'pc': h.profit_center, 'open': h.open} AS b
  FROM headers h JOIN (SELECT invoice_id, asset_id, sum(qty) AS mwh, sum(amount) AS usd FROM lines GROUP BY 1, 2) l
    USING (invoice_id), LATERAL (SELECT h.day0 + i AS market_date FROM (VALUES (0), (1), (2)) v(i)) d)
GROUP BY 1, 2, 3
""", ["headers", "lines"])


# --- documents and vectors ----------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given texts as contract documents with a heading before and a schedule after."""
    kind = F.when(F.col("lang") == "en", "PPA").when(F.col("lang") == "fr", "ISO_CURTAILMENT_NOTICE").otherwise("ISO_SETTLEMENT_STATEMENT")
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("bigint")
    body = F.concat(
        F.lit("Section 1.1: Contract Price and Term\nBuyer pays the contract rate for delivered MWh.\n"),
        F.col("text"),
        F.lit("\nSCHEDULE OF NOTICES\nNotice of a dispute is due ten  days after the claim.\nSCHEDULE OF NOTICES\nForce majeure excepted."),
    )
    return read(spark, sf_dir, "documents").select(
        _id("DOC", "doc_id").alias("document_id"), kind.alias("document_type"), F.col("source").alias("contract_id"),
        F.concat(F.lit("A"), (number + F.col("doc_id") % 7 * 20).cast("string")).alias("asset_id"),
        _day("doc_id").alias("event_date"), F.sha2("text", 256).alias("document_version_hash"),
        body.alias("raw_text_content"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))).alias(
            "ingested_at_timestamp"
        ),
    )


part("docs", """
SELECT 'DOC' || doc_id AS document_id, doc_id,
  CASE lang WHEN 'en' THEN 'PPA' WHEN 'fr' THEN 'ISO_CURTAILMENT_NOTICE' ELSE 'ISO_SETTLEMENT_STATEMENT' END AS document_type,
  source AS contract_id,
  'A' || (CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) + doc_id % 7 * 20) AS asset_id,
  DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS event_date, sha256(text) AS document_version_hash,
  'Section 1.1: Contract Price and Term' || chr(10) || 'Buyer pays the contract rate for delivered MWh.' || chr(10) || text
    || chr(10) || 'SCHEDULE OF NOTICES' || chr(10) || 'Notice of a dispute is due ten  days after the claim.'
    || chr(10) || 'SCHEDULE OF NOTICES' || chr(10) || 'Force majeure excepted.' AS body,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ingested_at
FROM documents
""")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), _id("src", "label").alias("contract_id"),
        _id("v", "label").alias("document_version_hash"),
        F.col("vec_id").cast("int").alias("chunk_index"), F.lit(1).alias("page_number"),
        F.lit("Terms").alias("section_heading"),
        F.when(F.col("embedding")[0] > 0, "curtailment").otherwise("notice").alias("clause_type"),
        _id("chunk ", "vec_id").alias("text_snippet"), F.lit("{}").alias("source_locator"),
        F.col("embedding").alias("embedding_vector"),
    )


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks for its neighbours in its own contract."""
    return read(spark, sf_dir, "embeddings").select(
        _id("E", "vec_id").alias("event_id"), _id("src", "label").alias("contract_id"),
        F.lit(None).cast("string").alias("document_version_hash"), F.col("embedding").alias("query_vector"),
        F.col("vec_id"), F.col("label"),
    )


def similarity_sql(k: int, where: str = "TRUE") -> str:
    return f"""
SELECT * FROM (
  SELECT event_id, chunk_id, contract_id, similarity,
    row_number() OVER (PARTITION BY event_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM (
    SELECT 'E' || q.vec_id AS event_id, c.vec_id AS chunk_id, 'src' || c.label AS contract_id,
      round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS similarity
    FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE {where}))
WHERE rank <= {k}
"""


part("found", similarity_sql(6))


# --- run, usage and approval facts ---------------------------------------------

def rag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select(
        _id("R", "o_orderkey").alias("rag_run_id"), _id("A", "o_custkey").alias("asset_id"),
        _contract("o_custkey").alias("contract_id"),
        F.when(F.col("o_orderstatus") != "P", _id("v", "o_custkey")).alias("document_version_hash"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("RUNNING").alias("status"),
        (key * 37 % 1000).alias("retrieval_latency_ms"), (key * 91 % 5000).alias("synthesis_latency_ms"),
        (key * 37 % 1000 + key * 91 % 5000).alias("total_latency_ms"),
        (key % 7).alias("retrieved_chunk_count"), (key % 100 / 100.0).alias("top_similarity_score"),
        (key % 5).alias("citation_count"), (p != "1-URGENT").alias("guardrail_passed"),
        (key % 11 == 0).alias("wrong_contract_blocked_flag"),
        (F.col("o_totalprice") >= 100000).alias("human_approval_required"),
        F.when(p == "2-HIGH", True).when(p == "3-MEDIUM", False).alias("human_approved"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("reason "), (key % 4).cast("string"))).alias("failure_reason"),
    )


part("runs", """
SELECT 'R' || o_orderkey AS rag_run_id, 'A' || o_custkey AS asset_id, 'src' || (o_custkey % 20) AS contract_id,
  CASE WHEN o_orderstatus <> 'P' THEN 'v' || o_custkey END AS version_hash, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status,
  o_orderkey * 37 % 1000 AS retrieval_ms, o_orderkey * 91 % 5000 AS synthesis_ms,
  o_orderkey * 37 % 1000 + o_orderkey * 91 % 5000 AS total_ms,
  o_orderkey % 7 AS chunks, o_orderkey % 100 / 100.0 AS top_similarity, o_orderkey % 5 AS citations,
  o_orderkey % 11 = 0 AS wrong_contract,
  o_orderpriority <> '1-URGENT' AS guard_ok, o_totalprice >= 100000 AS approval_required,
  CASE o_orderpriority WHEN '2-HIGH' THEN TRUE WHEN '3-MEDIUM' THEN FALSE END AS approved,
  CASE WHEN o_orderstatus = 'P' THEN 'reason ' || (o_orderkey % 4) END AS failure_reason, o_totalprice AS variance_usd,
  o_orderpriority AS priority, o_custkey, o_orderkey
FROM orders
""")


def llm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt, completion = (F.col("l_quantity") * 100).cast("bigint"), F.col("l_partkey") % 500
    return read(spark, sf_dir, "lineitem").select(
        _id("R", "l_orderkey").alias("rag_run_id"), _id("node", "l_linenumber").alias("node_name"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("model"), (F.col("l_suppkey") % 5).cast("string"))).alias("model_name"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"),
        (F.col("l_suppkey") * 3).alias("headroom_tokens_saved"), (F.col("l_linenumber") * 10).cast("bigint").alias("embedding_tokens"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models, each with five price periods of three years; the last is open."""
    n = F.col("n_nationkey")
    period = F.floor(n / 5).cast("int")
    start = F.add_months(F.lit("1990-01-01").cast("date"), period * 36)
    return read(spark, sf_dir, "nation").select(
        F.concat(F.lit("model"), (n % 5).cast("string")).alias("model_name"),
        ((n + 1) / 1000.0).alias("input_price_per_1k_tokens"), ((n + 2) / 500.0).alias("output_price_per_1k_tokens"),
        ((n + 1) / 2000.0).alias("embedding_price_per_1k_tokens"), start.alias("effective_start_date"),
        F.when(period < 4, F.add_months(start, 36)).alias("effective_end_date"),
    )


def cache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        _id("node", "l_linenumber").alias("component_name"),
        F.concat(F.lit("model"), (F.col("l_suppkey") % 5).cast("string")).alias("model_name"),
        (F.col("l_linestatus") == "O").alias("cache_hit"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def guard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        _id("R", "l_orderkey").alias("rag_run_id"), _id("guard", "l_linenumber").alias("guardrail_name"),
        (F.col("l_returnflag") != "R").alias("passed"),
    )


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    approved = F.when(p == "2-HIGH", True).when(p == "3-MEDIUM", False)
    created = F.col("o_orderdate").cast("timestamp")
    return read(spark, sf_dir, "orders").select(
        _id("AP", "o_orderkey").alias("approval_id"), _id("R", "o_orderkey").alias("rag_run_id"),
        (p != "5-LOW").alias("approval_required"), approved.alias("approved"), created.alias("created_at"),
        F.when(approved.isNotNull(), created + F.make_dt_interval(hours=(F.col("o_custkey") % 48).cast("int"))).alias("decision_timestamp"),
        F.col("o_totalprice").alias("variance_usd"),
    )


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_orderstatus") != "P"
    return read(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "2-HIGH").select(
        _id("X", "o_orderkey").alias("crm_dispatch_id"), F.lit("Salesforce").alias("target_system"),
        F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"), F.when(ok, _id("500", "o_orderkey")).alias("case_id"),
        _id("R", "o_orderkey").alias("rag_run_id"),
    )


part("usage", """
SELECT 'R' || l_orderkey AS rag_run_id, 'node' || l_linenumber AS node_name,
  CASE WHEN l_linenumber <> 7 THEN 'model' || (l_suppkey % 5) END AS model_name,
  CAST(l_quantity * 100 AS BIGINT) AS prompt, l_partkey % 500 AS completion, l_suppkey * 3 AS saved,
  CAST(l_linenumber * 10 AS BIGINT) AS embedding_tokens, CAST(l_shipdate AS DATE) AS usage_date,
  l_linestatus = 'O' AS cache_hit, 'model' || (l_suppkey % 5) AS cache_model
FROM lineitem
""")

part("models", """
SELECT 'model' || (n_nationkey % 5) AS model_name, (n_nationkey + 1) / 1000.0 AS price_in, (n_nationkey + 2) / 500.0 AS price_out,
  (n_nationkey + 1) / 2000.0 AS price_embed,
  CAST(DATE '1990-01-01' + to_months(CAST(36 * (n_nationkey // 5) AS INTEGER)) AS DATE) AS valid_from,
  CASE WHEN n_nationkey // 5 < 4 THEN CAST(DATE '1990-01-01' + to_months(CAST(36 * (n_nationkey // 5) + 36 AS INTEGER)) AS DATE) END AS valid_to
FROM nation
""")

part("priced", """
SELECT u.*, (u.prompt * coalesce(m.price_in, 0) + u.completion * coalesce(m.price_out, 0)) / 1000.0 AS cost,
  u.saved * coalesce(m.price_in, 0) / 1000.0 AS cost_saved, u.embedding_tokens * coalesce(m.price_embed, 0) / 1000.0 AS embed_cost
FROM usage u LEFT JOIN models m ON u.model_name = m.model_name AND u.usage_date >= m.valid_from
  AND (m.valid_to IS NULL OR u.usage_date < m.valid_to)
""", ["usage", "models"])
