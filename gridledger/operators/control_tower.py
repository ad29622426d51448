"""Operational KPIs over the run, usage, approval and dispatch facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.scalars import days_between, seconds_between, share
from gridledger.operators.quantiles import exact_quantile
from gridledger.session import materialize


def rate(condition: Column) -> Column:
    """Share of rows; an unknown condition counts as not met."""
    return share(F.count_if(condition), F.count("*"))


def exact_sum(value: Column | str) -> Column:
    """Sum of doubles that does not depend on the order of tasks."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast("decimal(28,9)")).cast("double")


def latency_stats(df: DataFrame, latency: str, *by: str) -> DataFrame:
    """Count, average and exact 95th percentile.

    Equal latencies are counted first and written; the percentile is selected
    among the distinct values without bringing them together.
    """
    counted = materialize(
        df.filter(F.col(latency).isNotNull()).groupBy(*by, latency).agg(F.count("*").alias("_n")), "latencies")
    found = exact_quantile(counted, list(by), latency, "_n", 0.95).withColumnsRenamed(
        {"average": "avg_latency_ms", "quantile": "p95_latency_ms"})
    if by:
        return found
    # One row also where there are no samples.
    return found.agg(*[F.max(c).alias(c) for c in ("samples", "avg_latency_ms", "p95_latency_ms")])


def top_failure(df: DataFrame, reason: str = "failure_reason") -> DataFrame:
    """The most common reason, ties by name."""
    return (
        df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("failures"))
        .orderBy(F.desc("failures"), reason).limit(1)
    )


def price_usage(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Tokens and cost per model and day at the price in force that day.

    Usage is summed per model and day before the range join, so a model with
    most of the calls contributes one row per day to it.
    """
    daily = usage.groupBy("model_name", F.to_date("created_at").alias("usage_date")).agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("headroom_tokens_saved").alias("tokens_saved"),
    )
    return _priced(daily, models, ["model_name", "usage_date"])


def _priced(grouped: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    prices = models.select(
        F.col("model_name").alias("_model"), "input_price_per_1k_tokens", "output_price_per_1k_tokens",
        "effective_start_date", "effective_end_date",
    )
    in_force = (
        (F.col("model_name") == F.col("_model"))
        & (F.col("usage_date") >= F.col("effective_start_date"))
        & (F.col("effective_end_date").isNull() | (F.col("usage_date") < F.col("effective_end_date")))
    )
    input_price = F.coalesce("input_price_per_1k_tokens", F.lit(0.0))
    output_price = F.coalesce("output_price_per_1k_tokens", F.lit(0.0))
    return (
        grouped.join(prices, in_force, "left")
        .withColumn("cost_usd", (F.col("prompt_tokens") * input_price + F.col("completion_tokens") * output_price) / 1000.0)
        .withColumn("cost_saved_usd", F.col("tokens_saved") * input_price / 1000.0)
        .drop("_model", "input_price_per_1k_tokens", "output_price_per_1k_tokens",
              "effective_start_date", "effective_end_date")
    )


def usage_by_run_day(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Cost per run; usage is summed per run, model and day first."""
    grouped = usage.groupBy("rag_run_id", "model_name", F.to_date("created_at").alias("usage_date")).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("headroom_tokens_saved").alias("tokens_saved"),
    )
    priced = _priced(grouped, models, ["rag_run_id", "model_name", "usage_date"])
    return priced.groupBy("rag_run_id").agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        exact_sum("cost_usd").alias("cost_usd"),
    )


def cost_daily(usage: DataFrame, models: DataFrame, cache_events: DataFrame) -> DataFrame:
    """The daily cost mart per component and model; a missing model is ''."""
    keys = ["cost_date", "component_name", "model_name"]
    by_day = usage.groupBy(
        F.to_date("created_at").alias("usage_date"), F.col("node_name").alias("component_name"), "model_name"
    ).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("headroom_tokens_saved").alias("tokens_saved"),
        F.count_distinct("rag_run_id").alias("runs"),
    )
    cost = (
        _priced(by_day, models, ["usage_date", "component_name", "model_name"])
        .groupBy(F.col("usage_date").alias("cost_date"), "component_name", F.coalesce("model_name", F.lit("")).alias("model_name"))
        .agg(
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
            exact_sum("cost_usd").alias("total_cost_usd"),
            F.sum("runs").alias("total_runs"),
            F.sum("tokens_saved").alias("headroom_tokens_saved"),
        )
    )
    cache = cache_events.groupBy(
        F.to_date("created_at").alias("cost_date"), "component_name",
        F.coalesce("model_name", F.lit("")).alias("model_name"),
    ).agg(
        F.count_if("cache_hit").alias("redis_cache_hits"), F.count_if(~F.col("cache_hit")).alias("redis_cache_misses")
    )
    zero = {c: 0 for c in ("total_tokens", "total_runs", "headroom_tokens_saved", "redis_cache_hits", "redis_cache_misses")}
    return cost.join(cache, keys, "full_outer").fillna({**zero, "total_cost_usd": 0.0})


def executive_kpis(gold: DataFrame, approvals: DataFrame, disputes: DataFrame) -> DataFrame:
    """Leakage, confirmed and approved amounts, open and closed disputes, pending approvals."""
    leak = gold.agg(exact_sum("estimated_leakage_revenue_usd").alias("total_leakage_usd"))
    decided = approvals.agg(
        exact_sum(F.when(F.col("approved"), F.col("variance_usd"))).alias("confirmed_leakage_usd"),
        F.count_if(F.col("approval_required") & F.col("approved").isNull()).alias("approvals_pending"),
    )
    return one_row(leak, decided, dispute_kpis(disputes))


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side: stacked, then reduced column by column."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def dispute_kpis(disputes: DataFrame) -> DataFrame:
    amount = F.col("estimated_dispute_amount_usd").cast("double")
    closed = F.col("status").startswith("Closed")
    return disputes.agg(
        exact_sum(F.when(~closed, amount)).alias("open_dispute_usd"),
        exact_sum(F.when(closed, amount)).alias("closed_dispute_usd"),
        exact_sum(F.col("approved_amount_usd").cast("double")).alias("approved_amount_usd"),
        F.avg(F.when(closed, days_between("closed_date", "created_date"))).alias("avg_days_to_resolution"),
    )


def pipeline_health(runs: DataFrame) -> DataFrame:
    """Success rate, row counts and failures per pipeline and layer."""
    ok = F.col("status") == "SUCCESS"
    return runs.groupBy("pipeline_name", "layer_name").agg(
        F.count("*").alias("runs"),
        rate(ok).alias("success_rate"),
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_written").alias("rows_written"),
        F.sum("rows_quarantined").alias("rows_quarantined"),
        F.sum("quality_failure_count").alias("quality_failures"),
        share(F.sum("rows_quarantined"), F.sum("rows_read")).alias("quality_failure_rate"),
        F.max(F.when(ok, F.col("completed_at"))).alias("last_success_at"),
    )


def platform_health(runs: DataFrame) -> DataFrame:
    """Success of snapshot and model runs and the last good refresh of the fact, over the whole run ledger."""
    ok, layer = F.col("status") == "SUCCESS", F.col("layer_name")
    models = layer.isin("silver", "gold")

    def success(which: Column) -> Column:
        return share(F.count_if(which & ok), F.count_if(which))

    return runs.agg(
        F.count_if(layer == "snapshot").alias("snapshot_runs"), success(layer == "snapshot").alias("snapshot_success_rate"),
        F.count_if(models).alias("model_runs"), success(models).alias("model_success_rate"),
        F.max(F.when((layer == "gold") & ok, F.col("completed_at"))).alias("last_gold_refresh_at"),
    )


def rag_kpis(runs: DataFrame) -> DataFrame:
    """Run counts and quality rates over all runs."""
    decided = F.col("human_approved").isNotNull()
    return runs.agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("status") == "SUCCESS").alias("successful_runs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_runs"),
        F.avg("retrieval_latency_ms").alias("avg_retrieval_ms"),
        F.avg("synthesis_latency_ms").alias("avg_synthesis_ms"),
        F.avg("retrieved_chunk_count").alias("avg_chunk_count"),
        (exact_sum("top_similarity_score") / F.count("top_similarity_score")).alias("avg_top_similarity"),
        F.count_if("wrong_contract_blocked_flag").alias("wrong_contract_blocked"),
        rate(F.col("retrieved_chunk_count") == 0).alias("no_evidence_rate"),
        rate(F.col("citation_count") > 0).alias("citation_coverage"),
        rate(~F.col("guardrail_passed")).alias("guardrail_failure_rate"),
        share(F.count_if(decided & ~F.col("human_approved")), F.count_if(decided)).alias("human_override_rate"),
        share(F.count_if("human_approved"), F.count_if(decided)).alias("acceptance_rate"),
        rate(F.col("document_version_hash").isNotNull()).alias("version_hash_coverage"),
    )


def guardrail_kpis(guards: DataFrame) -> DataFrame:
    return guards.groupBy("guardrail_name").agg(
        F.count("*").alias("events"),
        F.count_if(~F.col("passed")).alias("blocked"),
        rate(~F.col("passed")).alias("failure_rate"),
    )


def model_tokens(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model_name").agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("headroom_tokens_saved").alias("tokens_saved"),
    )


def embedding_cost(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Embedding tokens and cost per model at the price in force."""
    daily = usage.groupBy("model_name", F.to_date("created_at").alias("usage_date")).agg(
        F.sum("embedding_tokens").alias("embedding_tokens")
    )
    prices = models.select(
        F.col("model_name").alias("_model"), "embedding_price_per_1k_tokens", "effective_start_date", "effective_end_date"
    )
    in_force = (
        (F.col("model_name") == F.col("_model")) & (F.col("usage_date") >= F.col("effective_start_date"))
        & (F.col("effective_end_date").isNull() | (F.col("usage_date") < F.col("effective_end_date")))
    )
    cost = F.col("embedding_tokens") * F.coalesce("embedding_price_per_1k_tokens", F.lit(0.0)) / 1000.0
    return daily.join(prices, in_force, "left").groupBy("model_name").agg(
        F.sum("embedding_tokens").alias("embedding_tokens"), exact_sum(cost).alias("embedding_cost_usd")
    )


def run_costs(runs: DataFrame, usage: DataFrame, models: DataFrame) -> DataFrame:
    """Runs with their tokens and cost; runs without usage cost nothing."""
    return (
        runs.join(usage_by_run_day(usage, models), "rag_run_id", "left")
        .fillna({"total_tokens": 0, "cost_usd": 0.0})
    )


def unit_costs(costs: DataFrame) -> DataFrame:
    return costs.agg(
        exact_sum("cost_usd").alias("total_cost_usd"),
        share(exact_sum("cost_usd"), F.count("*")).alias("cost_per_run_usd"),
        share(exact_sum("cost_usd"), F.count_if("human_approval_required")).alias("cost_per_recommendation_usd"),
    )


def cost_by(costs: DataFrame, dim: str) -> DataFrame:
    return costs.groupBy(dim).agg(
        F.count("*").alias("runs"), F.sum("total_tokens").alias("total_tokens"), exact_sum("cost_usd").alias("cost_usd")
    )


def cache_rates(cache_events: DataFrame) -> DataFrame:
    hit = F.col("cache_hit")
    return cache_events.groupBy("component_name").agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
        rate(hit).alias("hit_rate"), rate(~hit).alias("miss_rate"),
    )


def runs_by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def node_stats(events: DataFrame) -> DataFrame:
    """Success, failure and retries per node, from normalised runtime events."""
    return events.groupBy("node_name").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "failure").alias("failures"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
    )


def approval_wait(approvals: DataFrame) -> DataFrame:
    waited = seconds_between("created_at", "decision_timestamp")
    return approvals.agg(
        F.count("decision_timestamp").alias("decided"),
        F.avg(waited).alias("avg_wait_seconds"),
        F.count_if(F.col("approval_required") & F.col("approved").isNull()).alias("pending"),
    )


def dispatch_kpis(dispatches: DataFrame) -> DataFrame:
    ok = F.col("status") == "SUCCESS"
    return dispatches.groupBy("target_system").agg(
        F.count("*").alias("dispatches"),
        rate(ok).alias("success_rate"),
        rate(~ok).alias("failure_rate"),
        F.count("case_id").alias("cases_created"),
    )


def audit_completeness(runs: DataFrame, required: list[str]) -> DataFrame:
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    return runs.agg(
        F.count("*").alias("records"), F.count_if(complete).alias("complete_records"),
        rate(complete).alias("complete_rate"),
    )


def governance(runs: DataFrame, approvals: DataFrame, high_value_usd: float = 5000.0) -> DataFrame:
    """Runs without evidence or approval, high amounts without approval, blocked runs, overrides."""
    per_run = approvals.groupBy("rag_run_id").agg(
        F.bool_or(F.coalesce("approved", F.lit(False))).alias("_approved"),
        F.max("variance_usd").alias("_usd"),
    )
    joined = runs.join(per_run, "rag_run_id", "left")
    approved = F.coalesce("_approved", F.lit(False))
    return joined.agg(
        F.count_if(F.coalesce("retrieved_chunk_count", F.lit(0)) == 0).alias("runs_missing_evidence"),
        F.count_if(F.col("human_approval_required") & ~approved).alias("runs_missing_approval"),
        F.count_if((F.col("_usd") >= high_value_usd) & ~approved).alias("high_value_without_approval"),
        F.count_if(~F.col("guardrail_passed")).alias("guardrail_blocked"),
        F.count_if(F.col("human_approved") == F.lit(False)).alias("manual_overrides"),
    )


def ingestion_lag(bronze: DataFrame) -> DataFrame:
    """Messages and lag between broker time and landing, per topic."""
    lag = seconds_between("kafka_timestamp", "bronze_ingested_at")
    return bronze.groupBy("kafka_topic").agg(
        F.count("*").alias("messages"), F.avg(lag).alias("avg_lag_seconds"), F.max(lag).alias("max_lag_seconds")
    )


def normalise_events(events: DataFrame) -> DataFrame:
    """Runtime events with the known metrics and attributes as typed columns.

    A time may carry a fraction and a zone offset; without one it counts as
    UTC. A text that is no time gives a null time and ``time_unparsed``.
    """
    metric, attribute = F.col("metrics"), F.col("attributes")

    def number(name: str, kind: str) -> Column:
        return F.try_element_at(metric, F.lit(name)).try_cast(kind).alias(name)

    def text(name: str) -> Column:
        return F.try_element_at(attribute, F.lit(name)).alias(name)

    return events.select(
        "event_id", "event_type", F.coalesce("node_name", "component_name").alias("node_name"),
        "status", "trace_id", "rag_run_id",
        F.try_to_timestamp("created_at_utc").alias("created_at"),
        (F.col("created_at_utc").isNotNull() & F.try_to_timestamp("created_at_utc").isNull()).alias("time_unparsed"),
        number("latency_ms", "long"), number("prompt_tokens", "long"), number("completion_tokens", "long"),
        number("retries", "long"), number("top_similarity", "double"),
        text("model_name"), text("error"), text("contract_id"),
    )


def usage_facts(normalised: DataFrame) -> DataFrame:
    """Language-model usage rows from normalised events."""
    return normalised.filter(F.col("event_type") == "llm_usage").select(
        F.col("event_id").alias("usage_id"), "rag_run_id", "trace_id", "node_name", "model_name",
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
        (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("total_tokens"),
        "created_at",
    )


def run_facts(normalised: DataFrame) -> DataFrame:
    """One row per run: span, events and overall status."""
    return normalised.filter(F.col("rag_run_id").isNotNull()).groupBy("rag_run_id").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("completed_at"),
        F.count("*").alias("events"),
        F.when(F.count_if(F.col("status") == "failure") > 0, "FAILED").otherwise("SUCCESS").alias("status"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.min(F.when(F.col("status") == "failure", F.col("error"))).alias("failure_reason"),
    )


def guardrail_facts(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("event_type") == "guardrail").select(
        F.col("event_id").alias("guardrail_event_id"), "rag_run_id", "trace_id",
        F.col("node_name").alias("guardrail_name"), (F.col("status") == "success").alias("passed"),
        F.col("error").alias("failure_reason"), "created_at",
    )


def dispatch_facts(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("event_type") == "crm_dispatch").select(
        F.col("event_id").alias("crm_dispatch_id"), "rag_run_id", "trace_id",
        F.when(F.col("status") == "success", "SUCCESS").otherwise("FAILED").alias("status"),
        F.col("error").alias("error_message"), "created_at",
    )


def approval_facts(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("event_type") == "approval").select(
        F.col("event_id").alias("approval_id"), "rag_run_id", "trace_id",
        F.lit(True).alias("approval_required"), (F.col("status") == "success").alias("approved"),
        F.col("created_at").alias("decision_timestamp"),
    )


def summary_document(executive: DataFrame, quality: DataFrame, finops: DataFrame) -> DataFrame:
    """One JSON document from three one-row KPI frames."""
    parts = {"executive_overview": executive, "rag_quality": quality, "llm_finops": finops}
    row = one_row(*parts.values())
    return row.select(F.to_json(F.struct(
        *[F.struct(*frame.columns).alias(name) for name, frame in parts.items()]
    )).alias("summary_json"))
