"""Queries that write the given tables in a delivery format and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions.scalars import cosine_similarity, time_text
from gridledger.operators import cases as case_ops
from gridledger.operators import documents as document_ops
from gridledger.plans import tables as t
from gridledger.plans.registry import query
from gridledger.profiles import text_schema
from gridledger.session import materialize, work_path
from gridledger.sources import files, merge, sinks


@query("landed_snapshot", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer
""")
def landed_snapshot(spark, sf_dir):
    """The customer table as a delimited delivery, landed as text columns."""
    path = work_path(spark, "snapshot")
    rows = t.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("C_CUSTKEY"), F.col("c_name").alias("C_NAME"), F.col("c_mktsegment").alias("C_MKTSEGMENT")
    )
    rows.write.option("header", True).csv(path + "/csv")
    files.land_snapshot(spark, path + "/csv", path + "/parquet", text_schema(*rows.columns))
    return spark.read.parquet(path + "/parquet")


@query("runtime_event_files", """
SELECT 'c' || conv_id || '-' || turn AS event_id, role AS node_name, length(text) AS latency_ms FROM conversations
""")
def runtime_event_files(spark, sf_dir):
    """Conversation turns as JSON lines of runtime events."""
    path = work_path(spark, "events")
    t.read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("event_id"),
        F.lit("node").alias("event_type"), F.col("role").alias("node_name"),
        F.struct(F.length("text").alias("latency_ms")).alias("metrics"),
    ).write.json(path)
    return files.scan_events(spark, path).select(
        "event_id", "node_name", F.col("metrics")["latency_ms"].cast("bigint").alias("latency_ms")
    )


@query("exported_breaches", """
SELECT sha256('BREACH|' || fact_record_hash) AS breach_event_id, strftime(hour_utc, '%Y-%m-%d %H:%M:%S') AS hour_utc,
  round(leakage_usd, 4) AS estimated_leakage_revenue_usd FROM gold WHERE leakage_usd > 0
""", ["gold"])
def exported_breaches(spark, sf_dir):
    path = work_path(spark, "export")
    rows = case_ops.breach_events(t.gold_fact(spark, sf_dir)).select(
        "breach_event_id", time_text("reconciliation_hour_utc").alias("hour_utc"),
        F.round("estimated_leakage_revenue_usd", 4).alias("estimated_leakage_revenue_usd"),
    )
    sinks.export_breach_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("appended_results", """
SELECT sha256('BREACH|' || fact_record_hash || '|2024-02-01 00:00:00') AS result_id FROM gold
UNION ALL SELECT sha256('BREACH|' || fact_record_hash || '|2024-02-02 00:00:00') FROM gold
""", ["gold"])
def appended_results(spark, sf_dir):
    """Two runs over all facts, each appended to the result table."""
    path = work_path(spark, "results")
    fact = t.stored_gold(spark, sf_dir).select("fact_record_hash")
    for day in ("2024-02-01", "2024-02-02"):
        result = F.sha2(F.concat(F.lit("BREACH|"), "fact_record_hash", F.lit(f"|{day} 00:00:00")), 256)
        sinks.append_results(fact.select(result.alias("result_id")), path)
    return spark.read.parquet(path)


@query("merged_daily_state", """
SELECT asset_id, strftime(event_ts_utc, '%Y-%m-%d') AS market_date, kafka_offset, measured_generation_kw FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, CAST(event_ts_utc AS DATE) ORDER BY kafka_offset DESC) AS n FROM silver)
WHERE n = 1
""", ["silver"])
def merged_daily_state(spark, sf_dir):
    """The newest reading per asset and day, merged into a table in two overlapping loads."""
    path = work_path(spark, "state")
    rows = t.silver_rows(spark, sf_dir).select(
        "asset_id", F.date_format("event_ts_utc", "yyyy-MM-dd").alias("market_date"), "kafka_offset", "measured_generation_kw"
    )
    for load in (rows.filter("market_date < '2024-01-20'"), rows.filter("market_date >= '2024-01-15'")):
        merge.merge_into(spark, path, load, ["asset_id", "market_date"], ["kafka_offset"], "market_date")
    return spark.read.option("basePath", path).parquet(path).select(
        "asset_id", F.col("market_date").cast("string").alias("market_date"), "kafka_offset", "measured_generation_kw"
    )


@query("reingested_documents", """
SELECT 'DOC' || doc_id AS document_id, i AS chunk_index, md5(substr(text, i * 750 + 1, 900)) AS text_md5,
  lang IS DISTINCT FROM 'de' AS is_new
FROM (SELECT doc_id, text, lang, unnest(range((length(text) + 749) // 750)) AS i FROM documents)
""")
def reingested_documents(spark, sf_dir):
    """All texts are in the tables with outdated chunks; every language but German is delivered again."""
    base = t.read(spark, sf_dir, "documents").select(
        F.concat(F.lit("DOC"), F.col("doc_id").cast("string")).alias("document_id"), F.col("lang").eqNullSafe("de").alias("german"),
        F.sha2("text", 256).alias("document_version_hash"), "text"
    )

    def parents(rows, prefix):
        return rows.select(
            F.concat(F.lit(prefix), "document_id").alias("parent_id"), F.col("document_id").alias("contract_id"),
            "document_version_hash", F.col("document_id").alias("source_file_name"),
            F.current_timestamp().alias("ingested_at_timestamp"),
        )

    def chunks(rows, prefix, fresh):
        cut = document_ops.window_chunks(rows, ["document_id", "german", "document_version_hash"], "text")
        # German texts keep their chunks; the outdated ones of the others are blank.
        kept = F.when(F.lit(fresh) | F.col("german"), F.col("text_snippet")).otherwise("outdated")
        # Stored: the joins count keys before they move rows, and texts are cut once.
        return materialize(cut.select(
            F.concat(F.lit(prefix), "document_id").alias("parent_id"), F.col("document_id").alias("contract_id"),
            "document_version_hash", "chunk_index", kept.alias("text_snippet"), F.lit(fresh).alias("is_new"),
        ), "chunks")

    again = base.filter(~F.col("german"))
    _, merged = merge.ingest_documents(
        parents(base, "P"), chunks(base, "P", False), parents(again, "Q"), chunks(again, "Q", True)
    )
    return merged.select(
        F.col("contract_id").alias("document_id"), "chunk_index", F.md5("text_snippet").alias("text_md5"), "is_new"
    )


@query("stored_outcomes", """
SELECT CASE WHEN code IS NULL THEN 'valid' ELSE 'quarantine' END AS outcome, code AS validation_error_code, count(*) AS row_count
FROM validated GROUP BY 1, 2
""", ["validated"])
def stored_outcomes(spark, sf_dir):
    """Both outcomes written in one pass and counted from the stored folders."""
    path = work_path(spark, "outcomes")
    sinks.write_outcomes(t.validated(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("outcome", "validation_error_code").agg(F.count("*").alias("row_count"))


@query("manifest_landing", """
SELECT 'crm/supplier' AS table_path, CAST(s_suppkey AS VARCHAR) AS row_key, s_name AS row_name FROM supplier
UNION ALL SELECT 'erp/customer', CAST(c_custkey AS VARCHAR), c_name FROM customer
""")
def manifest_landing(spark, sf_dir):
    """Two tables delivered as delimited files, landed as their manifest says."""
    path = work_path(spark, "delivery")
    delivered = {"supplier": ("crm", "s_suppkey", "s_name"), "customer": ("erp", "c_custkey", "c_name")}
    for table, (_, *columns) in delivered.items():
        t.read(spark, sf_dir, table).select(*columns).write.option("header", True).csv(f"{path}/in/{table}.csv")
    systems = F.array(*[F.struct(
        F.lit(zone.upper()).alias("source_system"), F.lit(zone).alias("landing_zone"),
        F.array(F.lit(f"{table}.csv")).alias("files")) for table, (zone, *_) in delivered.items()])
    spark.range(1).select(
        F.lit("x1").alias("extract_id"), F.lit("2024-01-01T00:00:00Z").alias("extract_timestamp_utc"), systems.alias("source_systems")
    ).write.json(path + "/manifest")
    schemas = {table: text_schema(*columns) for table, (_, *columns) in delivered.items()}
    targets = files.land_from_manifest(spark, path + "/manifest", path + "/in", path + "/out", schemas)
    rows = [
        spark.read.parquet(target).toDF("row_key", "row_name").select(
            F.lit("/".join(target.split("/")[-2:])).alias("table_path"), "row_key", "row_name") for target in sorted(targets)]
    return rows[0].unionByName(rows[1])


@query("json_array_files", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def json_array_files(spark, sf_dir):
    """Orders as files that each hold one JSON array of bounded length; their number follows from the rows."""
    path = work_path(spark, "arrays")
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    _in_files(rows, F.to_json(F.collect_list(F.struct(*rows.columns))), path)
    return files.scan_json_array(spark, path, rows.schema).select(*rows.columns)


_ROWS_PER_FILE = 1000


def _in_files(rows, text, path: str) -> None:
    """Rows dealt out by hash, about 1,000 to a file, and each file's rows as one ``text``."""
    count = -(-rows.count() // _ROWS_PER_FILE)
    dealt = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(max(count, 1))).alias("part")).agg(text.alias("text"))
    dealt.select("text").write.option("maxRecordsPerFile", 1).text(path)


_FILES_PER_FOLDER = 1000


def _file_each(rows, key: str, path: str) -> None:
    """Every row's ``text`` as a file of its own, about 1,000 to a folder; folders follow from the hash of ``key``.

    A folder is written by one task, however few parts the table is read in,
    so its files are committed by moving the folder and not one by one.
    """
    count = max(-(-rows.count() // _FILES_PER_FOLDER), 64)
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(count)).alias("folder"), "text").repartition(count, "folder")
    sinks.write_single_files(dealt, path, "folder")


@query("case_package_files", """
SELECT 'object' AS shape, 'B' || s_suppkey AS breach_event_id, s_name AS asset_name, 'PPA' AS document_type FROM supplier
UNION ALL SELECT 'list', 'B' || c_custkey, c_name, 'PPA' FROM customer
UNION ALL SELECT 'wrapped', 'B' || p_partkey, p_name, 'PPA' FROM part
""")
def case_package_files(spark, sf_dir):
    """Case packages delivered as single objects, as lists, and as objects with a list of cases."""
    shapes = {"object": ("supplier", "s_suppkey", "s_name"), "list": ("customer", "c_custkey", "c_name"), "wrapped": ("part", "p_partkey", "p_name")}
    path, found = work_path(spark, "packages"), []
    for shape, (table, key, name) in shapes.items():
        evidence = F.array(F.struct(F.lit(1).alias("context_rank"), F.lit("PPA").alias("document_type")))
        cases = t.read(spark, sf_dir, table).select(
            F.concat(F.lit("B"), F.col(key).cast("string")).alias("breach_event_id"), F.col(name).alias("asset_name"),
            evidence.alias("evidence_context"))
        target, listed = f"{path}/{shape}", F.collect_list(F.struct(*cases.columns))
        if shape == "object":
            _file_each(cases.select("breach_event_id", F.to_json(F.struct(*cases.columns)).alias("text")), "breach_event_id", target)
        else:
            _in_files(cases, F.to_json(listed if shape == "list" else F.struct(listed.alias("cases"))), target)
        found.append(files.scan_case_packages(spark, target).select(
            F.lit(shape).alias("shape"), "breach_event_id", "asset_name", F.col("evidence_context")[0]["document_type"].alias("document_type")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("registered_table", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def registered_table(spark, sf_dir):
    """A table saved under a checked name and read back by that name."""
    path = work_path(spark, "registered")
    name = f"default.suppliers_{path.rsplit('-', 1)[-1]}"
    sinks.register(t.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")), name, path=path)
    return spark.table(name)


@query("document_files", """
SELECT sha256(text || chr(10)) AS document_version_hash, md5(text || chr(10)) AS text_md5, count(*) AS file_count
FROM documents WHERE text IS NOT NULL GROUP BY text
""")
def document_files(spark, sf_dir):
    """Every text as a file of its own in hashed folders, read back with the hash of the file's bytes."""
    path = work_path(spark, "texts")
    _file_each(t.read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "doc_id", path)
    return files.scan_documents(spark, path).groupBy("document_version_hash", F.md5("raw_text_content").alias("text_md5")).agg(
        F.count("*").alias("file_count"))


@query("embedding_neighbours", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def embedding_neighbours(spark, sf_dir):
    """Similarity of each vector and the one with the next id."""
    rows = t.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(following, "vec_id").select(
        "vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("next")), 6).alias("similarity"))
