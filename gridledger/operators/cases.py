"""Breach events to explained and routed cases, one row per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridledger import fixed_values as fv
from gridledger.functions.scalars import fact_text, fill_template, hash_key, non_null, time_text
from gridledger.functions.skew import lookup_join, split_join

_BOOLEAN_FACTS = {"existing_open_dispute_flag"}
_DOUBLE_FACTS = {"eligible_compensable_mwh", "estimated_leakage_revenue_usd", "open_amount_usd"}
# What a breach and its documents have in common.
_DAY = ["contract_id", "asset_id", "market_date"]


def severity(usd: Column, high: float = 500.0, medium: float = 100.0) -> Column:
    return F.when(usd >= high, "HIGH").when(usd >= medium, "MEDIUM").otherwise("LOW")


def breach_events(gold: DataFrame, gate_status: str | Column = "PASSED") -> DataFrame:
    """Facts with leakage as breach events; nothing leaves a failed gate."""
    status = F.lit(gate_status) if isinstance(gate_status, str) else gate_status
    usd = F.col("estimated_leakage_revenue_usd")
    return (
        gold.withColumn("dq_gate_status", status)
        .filter((usd > 0) & (F.col("dq_gate_status") == "PASSED"))
        .select(
            hash_key(F.lit("BREACH"), "fact_record_hash").alias("breach_event_id"),
            "fact_record_hash",
            F.lit("CURTAILMENT_REVENUE_LEAKAGE").alias("breach_event_type"),
            "reconciliation_hour_utc",
            F.to_date("reconciliation_hour_utc").alias("market_date"),
            "asset_id",
            F.col("equip_name").alias("asset_name"),
            "asset_type", "iso_region",
            F.col("associated_ppa_id").alias("contract_id"),
            F.col("oftaker_name").alias("offtaker_name"),
            "curtailment_reason", "eligible_compensable_mwh", "expected_settlement_usd",
            "actual_settlement_usd", "estimated_leakage_revenue_usd",
            severity(usd).alias("breach_severity"),
            F.lit("EXPLAIN_REVENUE_LEAKAGE").alias("rag_task"),
            F.lit(True).alias("contract_lookup_required"),
            F.lit(True).alias("requires_human_approval"),
            F.lit(False).alias("salesforce_dispatch_allowed"),
            "dq_gate_status",
        )
    )


def recommend(df: DataFrame) -> DataFrame:
    """Next action: data gaps first, then an open dispute, then review."""
    gaps = F.col("contract_id").isNull() | F.col("invoice_id").isNull() | F.col("sf_account_id").isNull()
    return df.withColumn(
        "recommended_next_action",
        F.when(gaps, fv.ACTION_GAPS).when(F.col("existing_open_dispute_flag"), fv.ACTION_UPDATE).otherwise(fv.ACTION_READY),
    )


def _role(document_type: Column, part: int) -> Column:
    chosen = None
    for entry in fv.EVIDENCE_ROLES:
        hit = document_type == entry[0]
        chosen = F.when(hit, F.lit(entry[part])) if chosen is None else chosen.when(hit, F.lit(entry[part]))
    return chosen


def link_evidence(breaches: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per breach and supporting document.

    A contract document supports the breaches of its contract from its
    effective date until the next one of that contract; a notice or statement
    supports the breaches of its contract, asset and day. ``documents``:
    document_id, document_type, contract_id, asset_id, event_date.
    """
    typed = documents.withColumns({
        "evidence_role": _role(F.col("document_type"), 1),
        "role_rank": _role(F.col("document_type"), 2),
        "evidence_score": _role(F.col("document_type"), 3),
    }).filter(F.col("evidence_role").isNotNull())
    told = ["document_id", "document_type", "evidence_role", "role_rank", "evidence_score"]
    cases = breaches.select("breach_event_id", "contract_id", "asset_id", "market_date")

    dated = typed.filter(F.col("document_type") != fv.DOC_PPA).withColumnRenamed("event_date", "market_date")
    by_day = cases.join(dated.select("contract_id", "asset_id", "market_date", *told),
                        ["contract_id", "asset_id", "market_date"])

    # The version in force is looked up once per contract and day, not per breach.
    versions = typed.filter(F.col("document_type") == fv.DOC_PPA).groupBy("contract_id", "event_date").agg(
        F.max_by(F.struct(*told), "document_id").alias("d")
    )
    days = cases.select("contract_id", F.col("market_date").alias("event_date")).distinct()
    timeline = versions.withColumn("_wanted", F.lit(False)).unionByName(
        days.withColumn("_wanted", F.lit(True)), allowMissingColumns=True
    )
    so_far = W.partitionBy("contract_id").orderBy("event_date", "_wanted").rowsBetween(W.unboundedPreceding, 0)
    in_force = (
        timeline.withColumn("d", F.last("d", ignorenulls=True).over(so_far))
        .filter(F.col("_wanted") & F.col("d").isNotNull())
        .select("contract_id", F.col("event_date").alias("market_date"), "d.*")
    )
    by_contract = lookup_join(cases, in_force, ["contract_id", "market_date"], ["breach_event_id"], "inner")
    return by_day.select("breach_event_id", *told).unionByName(by_contract.select("breach_event_id", *told))


def case_days(breaches: DataFrame) -> DataFrame:
    """Each breach id with what its evidence depends on: contract, asset and day of its rows, and how many there are.

    ``day_key`` is equal where ``days`` is; as a rule an id has one row.
    """
    rows = breaches.groupBy("breach_event_id", *_DAY).agg(F.count("*").alias("rows"))
    days = F.array_sort(F.collect_list(F.struct(*_DAY, "rows")))
    return rows.groupBy("breach_event_id").agg(days.alias("days")).withColumn("day_key", F.sha2(F.to_json("days"), 256))


def distinct_days(days: DataFrame) -> DataFrame:
    """Rows to link in place of the breaches, with ``day_key`` as their id.

    Equal days come once. A breach that comes twice has its day twice, so its
    links are those of its rows.
    """
    once = days.select(F.col("day_key").alias("breach_event_id"), "days").distinct()
    return once.select("breach_event_id", F.inline("days")).select(
        "breach_event_id", *_DAY, F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")


def evidence_of_days(days: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence per breach from that of its days. ``days`` should be a stored table."""
    found = evidence.withColumnRenamed("breach_event_id", "day_key")
    return split_join(days.select("breach_event_id", "day_key"), found, ["day_key"], ["breach_event_id"]).drop("day_key")


def collect_evidence(links: DataFrame, chunks: DataFrame, k: int = fv.EVIDENCE_TOP_K) -> DataFrame:
    """Ranked evidence array per breach, at most k entries.

    Entries are ordered by role, score, document and chunk. Within a document
    the order is the chunk order, so chunks beyond the k-th can never be among
    the first k and are left out before the join. A document that supports a
    large share of the breaches is split.
    """
    by_document = W.partitionBy("document_id").orderBy("chunk_index")
    leading = (
        chunks.select("document_id", "chunk_index", F.col("text_snippet").alias("chunk_text"))
        .withColumn("_n", F.row_number().over(by_document)).filter(F.col("_n") <= k).drop("_n")
    )
    order = W.partitionBy("breach_event_id").orderBy(
        "role_rank", F.desc("evidence_score"), "document_id", "chunk_index"
    )
    joined = split_join(links, leading, ["document_id"], ["breach_event_id"])
    ranked = joined.withColumn("context_rank", F.row_number().over(order))
    entry = F.struct(
        "context_rank", "document_id", "document_type", "evidence_role", "evidence_score", "chunk_index", "chunk_text"
    )
    return ranked.filter(F.col("context_rank") <= k).groupBy("breach_event_id").agg(
        F.array_sort(F.collect_list(entry)).alias("evidence_context")
    )


def top_evidence(evidence: DataFrame, k: int = fv.EVIDENCE_TOP_K) -> DataFrame:
    """Evidence rows ranked per breach: rank (0 or null last), then score, then document and chunk."""
    order = W.partitionBy("breach_event_id").orderBy(
        F.coalesce(F.nullif("context_rank", F.lit(0)), F.lit(fv.UNRANKED)),
        F.desc(F.coalesce("evidence_score", F.lit(0))), "document_id", "chunk_index",
    )
    return evidence.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def top_evidence_array(evidence: Column, k: int = fv.EVIDENCE_TOP_K) -> Column:
    """The same ranking inside a row; equal entries keep their order."""
    keyed = F.transform(evidence, lambda e, i: F.struct(
        F.coalesce(F.nullif(e["context_rank"], F.lit(0)), F.lit(fv.UNRANKED)).alias("rank"),
        (-F.coalesce(e["evidence_score"], F.lit(0))).alias("score"),
        i.alias("place"), e.alias("entry"),
    ))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["entry"])


def case_package(case_ready: DataFrame, evidence: DataFrame, instruction: str) -> DataFrame:
    return case_ready.join(evidence, "breach_event_id", "left").withColumns({
        "evidence_context": F.coalesce(
            "evidence_context", F.array().cast(evidence.schema["evidence_context"].dataType)
        ),
        "rag_instruction": F.lit(instruction),
    })


def document_types(evidence: Column) -> Column:
    """Distinct document types of the evidence, sorted."""
    kinds = F.filter(F.transform(evidence, lambda e: e["document_type"]), lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(kinds))


def _is_blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def required_field_errors(fields: tuple[str, ...] = fv.REQUIRED_CASE_FIELDS) -> Column:
    """One message per required field that is null or empty."""
    return non_null(F.when(_is_blank(f), fv.MSG_MISSING_FIELD + f) for f in fields)


def validate_readiness(packages: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """READY or BLOCKED with messages; a requested id without a package is BLOCKED."""
    cases = packages.withColumn("_found", F.lit(True))
    if requested is not None:
        wanted = requested.select(F.col("breach_event_id").alias("requested_id")).distinct()
        cases = wanted.join(cases, F.col("requested_id") == F.col("breach_event_id"), "left")
    else:
        cases = cases.withColumn("requested_id", F.col("breach_event_id"))
    absent = F.when(F.col("_found").isNull(), F.concat(F.lit(fv.MSG_CASE_NOT_FOUND), "requested_id"))
    no_evidence = F.when(F.coalesce(F.size("evidence_context"), F.lit(0)) <= 0, F.lit(fv.MSG_NO_EVIDENCE_SUPPLIED))
    errors = F.concat(non_null([absent]), required_field_errors(), non_null([no_evidence]))
    return (
        cases.withColumn("validation_errors", errors)
        .withColumn("readiness_status", F.when(F.size("validation_errors") == 0, fv.READY).otherwise(fv.BLOCKED))
        .drop("_found")
    )


def _fact(name: str) -> Column:
    kind = "boolean" if name in _BOOLEAN_FACTS else "double" if name in _DOUBLE_FACTS else "string"
    return fact_text(name, kind)


def explanation_text(platform: str) -> Column:
    """The grounded explanation, filled from the case facts."""
    def support(kind: str) -> Column:
        return F.when(F.array_contains("_types", kind), "available").otherwise("not available")

    names = [part.partition("}")[0] for part in fv.EXPLANATION.split("{")[1:]]
    values = {n: _fact(n) for n in names if not n.endswith("_support") and n != "platform"}
    values.update(
        platform=F.lit(platform), ppa_support=support(fv.DOC_PPA),
        notice_support=support(fv.DOC_NOTICE), statement_support=support(fv.DOC_STATEMENT),
    )
    return fill_template(fv.EXPLANATION, values)


def explain(cases: DataFrame, platform: str = "Revenue assurance") -> DataFrame:
    return (
        cases.withColumn("_types", document_types(F.col("evidence_context")))
        .withColumn("rag_answer", explanation_text(platform))
        .drop("_types")
    )


def case_prompt(instructions: str) -> Column:
    """Instructions, labelled case facts and evidence blocks as one text."""
    facts = [
        F.concat(F.lit(f"{title}:\n"), F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), _fact(name)) for label, name in rows]))
        for title, rows in fv.PROMPT_FACTS
    ]

    def block(e: Column) -> Column:
        lines = [F.concat(F.lit(f"{label}: "), fact_text(e[name])) for label, name in fv.PROMPT_EVIDENCE]
        return F.concat(F.lit("\n"), F.concat_ws("\n", *lines, F.lit("Text:"), fact_text(e["chunk_text"])), F.lit("\n"))

    evidence = F.array_join(F.transform("evidence_context", block), "\n---\n")
    return F.trim(F.concat_ws("\n\n", F.lit(instructions.strip()), *facts, F.concat(F.lit("Evidence:\n"), evidence)))


def validate_grounding(cases: DataFrame) -> DataFrame:
    """Adds grounding errors to the case and settles READY or BLOCKED again."""
    answer = F.coalesce("rag_answer", F.lit(""))
    errors = [
        F.when(answer == "", fv.MSG_EMPTY_ANSWER),
        F.when(F.lower(answer).contains(fv.LEAKED_INSTRUCTION), fv.MSG_LEAKED_INSTRUCTION),
    ]
    for name in fv.GROUNDED_FIELDS:
        value = F.col(name)
        errors.append(F.when((value != "") & ~F.contains(answer, value), F.concat(F.lit(fv.MSG_NOT_MENTIONED), value)))
    errors.append(F.when(F.coalesce(F.size("evidence_context"), F.lit(0)) <= 0, fv.MSG_NO_EVIDENCE_USED))
    return cases.withColumn("validation_errors", F.concat("validation_errors", non_null(errors))).withColumn(
        "readiness_status", F.when(F.size("validation_errors") == 0, fv.READY).otherwise(fv.BLOCKED)
    )


def route(cases: DataFrame) -> DataFrame:
    """Queue of each case; no case is approved here."""
    action = F.col("recommended_next_action")
    return cases.withColumns({
        "final_route": F.when(F.col("readiness_status") != fv.READY, fv.ROUTE_BLOCKED)
        .when(action == fv.ACTION_READY, fv.ROUTE_REVIEW)
        .when(action == fv.ACTION_UPDATE, fv.ROUTE_UPDATE)
        .otherwise(fv.ROUTE_GAPS),
        "approved_for_salesforce": F.lit(False),
    })


def run_cases(
    packages: DataFrame, requested: DataFrame | None = None,
    platform: str = "Revenue assurance", instructions: str = "",
) -> DataFrame:
    """Every case from package to route; blocked cases keep their messages and no route."""
    checked = validate_readiness(packages, requested)
    ready = F.col("_ready")
    rows = checked.withColumn("_ready", F.coalesce(F.col("readiness_status") == fv.READY, F.lit(False))).withColumn(
        "_given", F.struct("evidence_context", "validation_errors", "readiness_status"))
    rows = rows.withColumn("evidence_context", F.when(ready, top_evidence_array(F.col("evidence_context"))))
    rows = rows.withColumn("prompt", F.when(ready, case_prompt(instructions)))
    rows = route(validate_grounding(explain(rows, platform)))
    # One pass for both: what was worked out for a blocked case is taken back.
    worked = ("rag_answer", "recommended_next_action", "final_route", "approved_for_salesforce")
    given = ("evidence_context", "validation_errors", "readiness_status")
    return rows.withColumns(
        {c: F.when(ready, F.col(c)) for c in worked}
        | {c: F.when(ready, F.col(c)).otherwise(F.col(f"_given.{c}")) for c in given}
        | {"approved_for_salesforce": F.when(ready, F.col("approved_for_salesforce")).otherwise(F.lit(False))}
    ).drop("_ready", "_given")


def result_rows(cases: DataFrame, at: Column, source: str = "BATCH_CASE_RUN") -> DataFrame:
    """Result records with nested columns as JSON."""
    facts = [c for c in cases.columns if c not in (
        "requested_id", "validation_errors", "readiness_status", "prompt", "rag_answer", "final_route",
        "approved_for_salesforce", "evidence_context")]
    case_id = F.coalesce("requested_id", F.lit("UNKNOWN"))
    return cases.select(
        hash_key(case_id, time_text(at)).alias("result_id"),
        at.alias("run_timestamp_utc"),
        case_id.alias("breach_event_id"),
        "readiness_status", "recommended_next_action", "final_route", "approved_for_salesforce",
        F.to_json("validation_errors").alias("validation_errors_json"),
        "rag_answer",
        F.to_json(F.struct(*facts)).alias("case_package_json"),
        F.coalesce(F.to_json("evidence_context"), F.lit("[]")).alias("evidence_used_json"),
        F.lit(source).alias("source_system"),
    )
