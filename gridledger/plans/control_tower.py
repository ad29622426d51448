"""Queries on operational KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions.scalars import time_text
from gridledger.operators import control_tower as ops
from gridledger.operators import silver
from gridledger.plans import tables as t
from gridledger.plans.registry import part, query
from gridledger.profiles import RUNTIME_EVENT_SCHEMA

_RATE = 9


def _r(name: str, digits: int = _RATE):
    return F.round(name, digits).alias(name)


@query("executive_kpis", """
SELECT round((SELECT sum(leakage_usd) FROM gold), 2) AS total_leakage_usd,
  round(sum(CASE WHEN approved THEN CAST(variance_usd AS DECIMAL(18,2)) END), 2)::DOUBLE AS confirmed_leakage_usd,
  count(*) FILTER (WHERE priority <> '5-LOW' AND approved IS NULL) AS approvals_pending,
  (SELECT sum(CASE WHEN status NOT LIKE 'Closed%' THEN amount END) FROM disputes)::DOUBLE AS open_dispute_usd,
  (SELECT sum(CASE WHEN status LIKE 'Closed%' THEN amount END) FROM disputes)::DOUBLE AS closed_dispute_usd,
  (SELECT sum(approved) FROM disputes)::DOUBLE AS approved_amount_usd,
  (SELECT round(avg(days_open), 9) FROM disputes) AS avg_days_to_resolution
FROM runs
""", ["gold", "disputes", "runs"])
def executive_kpis(spark, sf_dir):
    return ops.executive_kpis(t.gold_fact(spark, sf_dir), t.approvals(spark, sf_dir), t.disputes(spark, sf_dir)).withColumns({
        "total_leakage_usd": F.round("total_leakage_usd", 2), "confirmed_leakage_usd": F.round("confirmed_leakage_usd", 2),
        "avg_days_to_resolution": F.round("avg_days_to_resolution", 9),
    })


@query("dispute_kpis", """
SELECT sum(CASE WHEN status NOT LIKE 'Closed%' THEN amount END)::DOUBLE AS open_dispute_usd,
  sum(CASE WHEN status LIKE 'Closed%' THEN amount END)::DOUBLE AS closed_dispute_usd,
  sum(approved)::DOUBLE AS approved_amount_usd, round(avg(days_open), 9) AS avg_days_to_resolution FROM disputes
""", ["disputes"])
def dispute_kpis(spark, sf_dir):
    return ops.dispute_kpis(t.disputes(spark, sf_dir)).withColumn(
        "avg_days_to_resolution", F.round("avg_days_to_resolution", 9)
    )


def pipeline_runs(spark, sf_dir):
    """The run ledger: Silver per day and source partition, snapshots per delivery day, the fact per market day.

    A Silver day with schema trouble failed, a snapshot with urgent orders still
    pending, a fact day with hours that lack a contract.
    """
    def runs(rows, name, layer, day, failures, completed, written=None):
        written = F.lit(True) if written is None else written
        return rows.groupBy(name.alias("pipeline_name"), F.lit(layer).alias("layer_name"), day.alias("day")).agg(
            F.count("*").alias("rows_read"), F.count_if(written).alias("rows_written"), F.count_if(~written).alias("rows_quarantined"),
            F.count_if(failures).alias("quality_failure_count"), F.max(completed).alias("completed_at"))

    code = F.col("validation_error_code")
    silver_runs = runs(
        t.validated(spark, sf_dir), F.concat(F.lit("silver"), F.col("kafka_partition").cast("string")), "silver",
        F.to_date("kafka_timestamp"), code == "INVALID_TIMESTAMP", F.col("bronze_ingested_at"), written=code.isNull())
    pending = F.col("o_orderstatus") == "P"
    snapshots = runs(
        t.read(spark, sf_dir, "orders"), F.lit("snapshot_orders"), "snapshot", F.col("o_orderdate").cast("date"),
        pending & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 hour"),
        written=~pending)
    hour = F.col("reconciliation_hour_utc")
    facts = runs(
        t.gold_fact(spark, sf_dir), F.lit("fact_revenue_leakage"), "gold", F.to_date(hour), F.col("associated_ppa_id").isNull(),
        hour + F.expr("interval 2 hours"))
    return silver_runs.unionByName(snapshots).unionByName(facts).withColumn(
        "status", F.when(F.col("quality_failure_count") > 0, "FAILED").otherwise("SUCCESS"))


part("ledger", """
SELECT 'silver' || kafka_partition AS pipeline_name, 'silver' AS layer_name, CAST(kafka_timestamp AS DATE) AS day, count(*) AS n,
  count(*) FILTER (WHERE code IS NULL) AS ok, count(*) FILTER (WHERE code = 'INVALID_TIMESTAMP') AS bad, max(bronze_ingested_at) AS done
FROM validated GROUP BY ALL
UNION ALL
SELECT 'snapshot_orders', 'snapshot', CAST(o_orderdate AS DATE) AS day, count(*), count(*) FILTER (WHERE o_orderstatus <> 'P'),
  count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), max(CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 1 HOUR
FROM orders GROUP BY ALL
UNION ALL
SELECT 'fact_revenue_leakage', 'gold', CAST(hour_utc AS DATE) AS day, count(*), count(*), count(*) FILTER (WHERE associated_ppa_id IS NULL),
  max(hour_utc) + INTERVAL 2 HOUR FROM gold GROUP BY ALL
""", ["validated", "gold"])


@query("ingest_health", """
SELECT pipeline_name, layer_name, count(*) AS runs, round(avg(CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END), 9) AS success_rate,
  sum(n)::BIGINT AS rows_read, sum(ok)::BIGINT AS rows_written, sum(n - ok)::BIGINT AS rows_quarantined, sum(bad)::BIGINT AS quality_failures,
  round(sum(n - ok) / sum(n)::DOUBLE, 9) AS quality_failure_rate,
  strftime(max(CASE WHEN bad = 0 THEN done END), '%Y-%m-%d %H:%M:%S') AS last_success_at
FROM ledger GROUP BY 1, 2
""", ["ledger"])
def ingest_health(spark, sf_dir):
    return ops.pipeline_health(pipeline_runs(spark, sf_dir)).select(
        "pipeline_name", "layer_name", "runs", _r("success_rate"), "rows_read", "rows_written", "rows_quarantined", "quality_failures",
        _r("quality_failure_rate"), time_text("last_success_at").alias("last_success_at"),
    )


@query("platform_health", """
SELECT count(*) FILTER (WHERE layer_name = 'snapshot') AS snapshot_runs,
  round(avg(CASE WHEN layer_name = 'snapshot' THEN CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END END), 9) AS snapshot_success_rate,
  count(*) FILTER (WHERE layer_name <> 'snapshot') AS model_runs,
  round(avg(CASE WHEN layer_name <> 'snapshot' THEN CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END END), 9) AS model_success_rate,
  strftime(max(CASE WHEN layer_name = 'gold' AND bad = 0 THEN done END), '%Y-%m-%d %H:%M:%S') AS last_gold_refresh_at
FROM ledger
""", ["ledger"])
def platform_health(spark, sf_dir):
    """Snapshot and model success and the last refresh of the fact."""
    return ops.platform_health(pipeline_runs(spark, sf_dir)).withColumns({
        "snapshot_success_rate": F.round("snapshot_success_rate", _RATE), "model_success_rate": F.round("model_success_rate", _RATE),
        "last_gold_refresh_at": time_text("last_gold_refresh_at")})


@query("layer_row_counts", """
SELECT 'all' AS scope, count(*) AS rows_read, count(*) FILTER (WHERE code IS NULL) AS rows_written,
  count(*) FILTER (WHERE code IS NOT NULL) AS rows_quarantined FROM validated
""", ["validated"])
def layer_row_counts(spark, sf_dir):
    return silver.row_accounting(t.validated(spark, sf_dir)).withColumn("scope", F.lit("all"))


@query("rag_run_kpis", """
SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'SUCCESS') AS successful_runs,
  count(*) FILTER (WHERE status = 'FAILED') AS failed_runs, round(avg(retrieval_ms), 6) AS avg_retrieval_ms,
  round(avg(synthesis_ms), 6) AS avg_synthesis_ms, round(avg(chunks), 6) AS avg_chunk_count,
  round(sum(CAST(top_similarity AS DECIMAL(18,2)))::DOUBLE / count(*), 9) AS avg_top_similarity,
  count(*) FILTER (WHERE wrong_contract) AS wrong_contract_blocked,
  round(avg(CASE WHEN chunks = 0 THEN 1.0 ELSE 0.0 END), 9) AS no_evidence_rate,
  round(avg(CASE WHEN citations > 0 THEN 1.0 ELSE 0.0 END), 9) AS citation_coverage,
  round(avg(CASE WHEN guard_ok THEN 0.0 ELSE 1.0 END), 9) AS guardrail_failure_rate,
  round(avg(CASE WHEN approved THEN 0.0 WHEN NOT approved THEN 1.0 END), 9) AS human_override_rate,
  round(avg(CASE WHEN approved THEN 1.0 WHEN NOT approved THEN 0.0 END), 9) AS acceptance_rate,
  round(avg(CASE WHEN version_hash IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS version_hash_coverage
FROM runs
""", ["runs"])
def rag_run_kpis(spark, sf_dir):
    out = ops.rag_kpis(t.rag_runs(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("avg_retrieval_ms", "avg_synthesis_ms", "avg_chunk_count")}
    rates = [c for c in out.columns if c.endswith(("_rate", "_coverage", "_similarity"))]
    return out.withColumns(rounded | {c: F.round(c, _RATE) for c in rates})


@query("run_latency", """
SELECT status, count(*) AS samples, round(avg(total_ms), 6) AS avg_latency_ms,
  round(quantile_cont(CAST(total_ms AS DOUBLE), 0.95), 6) AS p95_latency_ms FROM runs GROUP BY 1
""", ["runs"])
def run_latency(spark, sf_dir):
    return ops.latency_stats(t.rag_runs(spark, sf_dir), "total_latency_ms", "status").select(
        "status", "samples", _r("avg_latency_ms", 6), _r("p95_latency_ms", 6)
    )


@query("run_latency_overall", """
SELECT count(*) AS samples, round(avg(total_ms), 6) AS avg_latency_ms,
  round(quantile_cont(CAST(total_ms AS DOUBLE), 0.95), 6) AS p95_latency_ms FROM runs
""", ["runs"])
def run_latency_overall(spark, sf_dir):
    return ops.latency_stats(t.rag_runs(spark, sf_dir), "total_latency_ms").select(
        "samples", _r("avg_latency_ms", 6), _r("p95_latency_ms", 6)
    )


@query("guardrail_kpis", """
SELECT 'guard' || l_linenumber AS guardrail_name, count(*) AS events, count(*) FILTER (WHERE l_returnflag = 'R') AS blocked,
  round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 9) AS failure_rate FROM lineitem GROUP BY 1
""")
def guardrail_kpis(spark, sf_dir):
    return ops.guardrail_kpis(t.guard_events(spark, sf_dir)).withColumn("failure_rate", F.round("failure_rate", _RATE))


@query("tokens_by_model", """
SELECT model_name, count(*) AS calls, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens,
  sum(prompt + completion)::BIGINT AS total_tokens, sum(saved)::BIGINT AS tokens_saved FROM usage GROUP BY 1
""", ["usage"])
def tokens_by_model(spark, sf_dir):
    return ops.model_tokens(t.llm_usage(spark, sf_dir))


@query("usage_cost", """
SELECT model_name, strftime(usage_date, '%Y-%m-%d') AS usage_date, count(*) AS calls, sum(prompt)::BIGINT AS prompt_tokens,
  round(sum(cost), 6) AS cost_usd, round(sum(cost_saved), 6) AS cost_saved_usd FROM priced GROUP BY 1, 2
""", ["priced"])
def usage_cost(spark, sf_dir):
    return ops.price_usage(t.llm_usage(spark, sf_dir), t.models(spark, sf_dir)).select(
        "model_name", F.date_format("usage_date", "yyyy-MM-dd").alias("usage_date"), "calls", "prompt_tokens",
        _r("cost_usd", 6), _r("cost_saved_usd", 6),
    )


@query("embedding_cost", """
SELECT model_name, sum(embedding_tokens)::BIGINT AS embedding_tokens, round(sum(embed_cost), 6) AS embedding_cost_usd FROM priced GROUP BY 1
""", ["priced"])
def embedding_cost(spark, sf_dir):
    return ops.embedding_cost(t.llm_usage(spark, sf_dir), t.models(spark, sf_dir)).withColumn(
        "embedding_cost_usd", F.round("embedding_cost_usd", 6)
    )


@query("daily_cost_mart", """
SELECT strftime(coalesce(c.day, h.day), '%Y-%m-%d') AS cost_date, coalesce(c.node, h.node) AS component_name,
  coalesce(c.model, h.model) AS model_name, coalesce(tokens, 0)::BIGINT AS total_tokens, round(coalesce(cost, 0), 6) AS total_cost_usd,
  coalesce(n, 0) AS total_runs, coalesce(saved, 0)::BIGINT AS headroom_tokens_saved, coalesce(hits, 0) AS redis_cache_hits,
  coalesce(misses, 0) AS redis_cache_misses
FROM (SELECT usage_date AS day, node_name AS node, coalesce(model_name, '') AS model, sum(prompt + completion) AS tokens, sum(cost) AS cost,
    count(DISTINCT rag_run_id) AS n, sum(saved) AS saved FROM priced GROUP BY 1, 2, 3) c
FULL JOIN (SELECT usage_date AS day, node_name AS node, cache_model AS model, count(*) FILTER (WHERE cache_hit) AS hits,
    count(*) FILTER (WHERE NOT cache_hit) AS misses FROM usage GROUP BY 1, 2, 3) h
  ON c.day = h.day AND c.node = h.node AND c.model = h.model
""", ["priced"])
def daily_cost_mart(spark, sf_dir):
    return ops.cost_daily(t.llm_usage(spark, sf_dir), t.models(spark, sf_dir), t.cache_events(spark, sf_dir)).withColumns({
        "cost_date": F.date_format("cost_date", "yyyy-MM-dd"), "total_cost_usd": F.round("total_cost_usd", 6),
    })


part("costs", """
SELECT r.*, coalesce(tokens, 0) AS tokens, coalesce(cost, 0.0) AS cost FROM runs r LEFT JOIN (
  SELECT rag_run_id, sum(prompt + completion) AS tokens, sum(cost) AS cost FROM priced GROUP BY 1) USING (rag_run_id)
""", ["runs", "priced"])


def costs(spark, sf_dir):
    return ops.run_costs(t.rag_runs(spark, sf_dir), t.llm_usage(spark, sf_dir), t.models(spark, sf_dir))


@query("unit_costs", """
SELECT round(sum(cost), 2) AS total_cost_usd, round(sum(cost) / count(*), 5) AS cost_per_run_usd,
  round(sum(cost) / count(*) FILTER (WHERE approval_required), 5) AS cost_per_recommendation_usd FROM costs
""", ["costs"])
def unit_costs(spark, sf_dir):
    return ops.unit_costs(costs(spark, sf_dir)).select(
        _r("total_cost_usd", 2), _r("cost_per_run_usd", 5), _r("cost_per_recommendation_usd", 5)
    )


def _cost_by(name: str, dim: str) -> None:
    @query(name, f"""
SELECT {dim}, count(*) AS runs, sum(tokens)::BIGINT AS total_tokens, round(sum(cost), 6) AS cost_usd FROM costs GROUP BY 1
""", ["costs"])
    def run(spark, sf_dir):
        return ops.cost_by(costs(spark, sf_dir), dim).withColumn("cost_usd", F.round("cost_usd", 6))


_cost_by("cost_by_contract", "contract_id")
_cost_by("cost_by_asset", "asset_id")


@query("cache_rates", """
SELECT node_name AS component_name, count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE NOT cache_hit) AS misses,
  round(avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END), 9) AS hit_rate, round(avg(CASE WHEN cache_hit THEN 0.0 ELSE 1.0 END), 9) AS miss_rate
FROM usage GROUP BY 1
""", ["usage"])
def cache_rates(spark, sf_dir):
    return ops.cache_rates(t.cache_events(spark, sf_dir)).withColumns({
        "hit_rate": F.round("hit_rate", _RATE), "miss_rate": F.round("miss_rate", _RATE)})


@query("runs_by_status", "SELECT status, count(*) AS runs FROM runs GROUP BY 1", ["runs"])
def runs_by_status(spark, sf_dir):
    return ops.runs_by_status(t.rag_runs(spark, sf_dir))


@query("approval_wait", """
SELECT count(*) FILTER (WHERE approved IS NOT NULL) AS decided,
  round(avg(CASE WHEN approved IS NOT NULL THEN o_custkey % 48 * 3600 END), 6) AS avg_wait_seconds,
  count(*) FILTER (WHERE priority <> '5-LOW' AND approved IS NULL) AS pending FROM runs
""", ["runs"])
def approval_wait(spark, sf_dir):
    return ops.approval_wait(t.approvals(spark, sf_dir)).withColumn("avg_wait_seconds", F.round("avg_wait_seconds", 6))


@query("dispatch_kpis", """
SELECT 'Salesforce' AS target_system, count(*) AS dispatches, round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END), 9) AS success_rate,
  round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END), 9) AS failure_rate, count(*) FILTER (WHERE o_orderstatus <> 'P') AS cases_created
FROM orders WHERE o_orderpriority = '2-HIGH'
""")
def dispatch_kpis(spark, sf_dir):
    return ops.dispatch_kpis(t.dispatches(spark, sf_dir)).withColumns({
        "success_rate": F.round("success_rate", _RATE), "failure_rate": F.round("failure_rate", _RATE)})


@query("top_failure_reason", """
SELECT failure_reason, count(*) AS failures FROM runs WHERE failure_reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1
""", ["runs"])
def top_failure_reason(spark, sf_dir):
    return ops.top_failure(t.rag_runs(spark, sf_dir))


@query("audit_completeness", """
SELECT count(*) AS records, count(*) FILTER (WHERE version_hash IS NOT NULL AND approved IS NOT NULL) AS complete_records,
  round(avg(CASE WHEN version_hash IS NOT NULL AND approved IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS complete_rate FROM runs
""", ["runs"])
def audit_completeness(spark, sf_dir):
    return ops.audit_completeness(
        t.rag_runs(spark, sf_dir), ["rag_run_id", "contract_id", "document_version_hash", "human_approved"]
    ).withColumn("complete_rate", F.round("complete_rate", _RATE))


@query("governance_kpis", """
SELECT count(*) FILTER (WHERE chunks = 0) AS runs_missing_evidence,
  count(*) FILTER (WHERE approval_required AND NOT coalesce(approved, FALSE)) AS runs_missing_approval,
  count(*) FILTER (WHERE variance_usd >= 5000 AND NOT coalesce(approved, FALSE)) AS high_value_without_approval,
  count(*) FILTER (WHERE NOT guard_ok) AS guardrail_blocked, count(*) FILTER (WHERE NOT approved) AS manual_overrides FROM runs
""", ["runs"])
def governance_kpis(spark, sf_dir):
    return ops.governance(t.rag_runs(spark, sf_dir), t.approvals(spark, sf_dir))


# --- runtime events ------------------------------------------------------------------

def runtime_events(spark, sf_dir):
    """Order lines written as runtime event records and read back from JSON."""
    kind = F.when(F.col("l_linenumber") <= 3, "llm_usage").when(F.col("l_linenumber") == 4, "guardrail").when(
        F.col("l_linenumber") == 5, "crm_dispatch").otherwise("approval")
    failed = F.col("l_returnflag") == "R"
    text = F.concat(
        F.lit('{"event_id":"e'), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"),
        F.col("l_partkey").cast("string"), F.lit('","event_type":"'), kind, F.lit('","node_name":"node'),
        F.col("l_linenumber").cast("string"), F.lit('","status":"'), F.when(failed, "failure").otherwise("success"),
        F.lit('","trace_id":"t","rag_run_id":"R'), F.col("l_orderkey").cast("string"),
        F.lit('","created_at_utc":"'), F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.lit('T10:00:00.123456+00:00","metrics":{"latency_ms":'), F.col("l_quantity").cast("int").cast("string"),
        F.lit(',"prompt_tokens":'), F.col("l_partkey").cast("string"), F.lit(',"retries":'),
        (F.col("l_suppkey") % 3).cast("string"), F.lit('},"attributes":{"model_name":"m","error":'),
        F.when(failed, F.concat(F.lit('"E'), F.col("l_linenumber").cast("string"), F.lit('"'))).otherwise("null"), F.lit("}}"),
    )
    # Inlining a one-element array keeps later filters from parsing the text a second time.
    records = t.read(spark, sf_dir, "lineitem").select(F.inline(F.array(F.from_json(text, RUNTIME_EVENT_SCHEMA))))
    return ops.normalise_events(records)


@query("node_statistics", """
SELECT 'node' || l_linenumber AS node_name, count(*) AS events, count(*) FILTER (WHERE l_returnflag <> 'R') AS successes,
  count(*) FILTER (WHERE l_returnflag = 'R') AS failures, sum(l_suppkey % 3)::BIGINT AS retries FROM lineitem GROUP BY 1
""")
def node_statistics(spark, sf_dir):
    return ops.node_stats(runtime_events(spark, sf_dir))


@query("node_latency", """
SELECT 'node' || l_linenumber AS node_name, count(*) AS samples, round(avg(CAST(l_quantity AS INTEGER)), 6) AS avg_latency_ms,
  round(quantile_cont(l_quantity, 0.95), 6) AS p95_latency_ms FROM lineitem GROUP BY 1
""")
def node_latency(spark, sf_dir):
    return ops.latency_stats(runtime_events(spark, sf_dir), "latency_ms", "node_name").select(
        "node_name", "samples", _r("avg_latency_ms", 6), _r("p95_latency_ms", 6)
    )


@query("usage_facts", """
SELECT 'e' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS usage_id, 'R' || l_orderkey AS rag_run_id, 'm' AS model_name,
  l_partkey AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens, l_partkey AS total_tokens,
  strftime(l_shipdate, '%Y-%m-%d') || ' 10:00:00' AS created_at FROM lineitem WHERE l_linenumber <= 3
""")
def usage_facts(spark, sf_dir):
    return ops.usage_facts(runtime_events(spark, sf_dir)).select(
        "usage_id", "rag_run_id", "model_name", "prompt_tokens", "completion_tokens", "total_tokens",
        time_text("created_at").alias("created_at"),
    )


@query("run_facts", """
SELECT 'R' || l_orderkey AS rag_run_id, count(*) AS events, strftime(min(l_shipdate), '%Y-%m-%d') || ' 10:00:00' AS started_at,
  CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS total_latency_ms, min(CASE WHEN l_returnflag = 'R' THEN 'E' || l_linenumber END) AS failure_reason
FROM lineitem GROUP BY l_orderkey
""")
def run_facts(spark, sf_dir):
    return ops.run_facts(runtime_events(spark, sf_dir)).select(
        "rag_run_id", "events", time_text("started_at").alias("started_at"), "status", "total_latency_ms", "failure_reason"
    )


def _outcomes(name: str, build, number: str, flag) -> None:
    @query(name, f"""
SELECT 'R' || l_orderkey AS rag_run_id, count(*) AS events, count(*) FILTER (WHERE l_returnflag <> 'R') AS good
FROM lineitem WHERE {number} GROUP BY l_orderkey
""")
    def run(spark, sf_dir):
        return build(runtime_events(spark, sf_dir)).groupBy("rag_run_id").agg(
            F.count("*").alias("events"), F.count_if(flag()).alias("good")
        )


_outcomes("guardrail_facts", ops.guardrail_facts, "l_linenumber = 4", lambda: F.col("passed"))
_outcomes("dispatch_facts", ops.dispatch_facts, "l_linenumber = 5", lambda: F.col("status") == "SUCCESS")
_outcomes("approval_facts", ops.approval_facts, "l_linenumber > 5", lambda: F.col("approved"))


@query("summary_document", """
SELECT round((SELECT sum(leakage_usd) FROM gold), 2) AS total_leakage_usd,
  count(*) FILTER (WHERE priority <> '5-LOW' AND approved IS NULL) AS approvals_pending, count(*) AS rag_runs,
  round(avg(CASE WHEN guard_ok THEN 1.0 ELSE 0.0 END), 9) AS guardrail_pass_rate,
  (SELECT sum(prompt + completion)::BIGINT FROM usage) AS total_tokens,
  (SELECT round(sum(cost), 4) FROM priced) AS estimated_llm_cost_usd
FROM runs
""", ["gold", "runs", "usage", "priced"])
def summary_document(spark, sf_dir):
    """The one-document summary, with some of its numbers read back from the JSON text."""
    facts = t.gold_fact(spark, sf_dir)
    executive = ops.executive_kpis(facts, t.approvals(spark, sf_dir), t.disputes(spark, sf_dir))
    quality = ops.rag_kpis(t.rag_runs(spark, sf_dir)).select(
        F.col("total_runs").alias("rag_runs"), (1 - F.col("guardrail_failure_rate")).alias("guardrail_pass_rate"),
        F.col("citation_coverage").alias("citation_coverage_rate"),
        F.col("avg_top_similarity").alias("average_top_similarity"),
    )
    usage = ops.price_usage(t.llm_usage(spark, sf_dir), t.models(spark, sf_dir)).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        ops.exact_sum("cost_usd").alias("estimated_llm_cost_usd"), F.sum("tokens_saved").alias("headroom_tokens_saved"),
    )

    def value(path: str, kind: str):
        return F.get_json_object("summary_json", f"$.{path}").cast(kind)

    return ops.summary_document(executive, quality, usage).select(
        F.round(value("executive_overview.total_leakage_usd", "double"), 2).alias("total_leakage_usd"),
        value("executive_overview.approvals_pending", "bigint").alias("approvals_pending"),
        value("rag_quality.rag_runs", "bigint").alias("rag_runs"),
        F.round(value("rag_quality.guardrail_pass_rate", "double"), 9).alias("guardrail_pass_rate"),
        value("llm_finops.total_tokens", "bigint").alias("total_tokens"),
        F.round(value("llm_finops.estimated_llm_cost_usd", "double"), 4).alias("estimated_llm_cost_usd"),
    )
