"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from gridledger.plans.catalog import QUERIES
from gridledger.session import build_session

HEADLINE = (
    "gold_leakage_fact",
    "silver_valid",
    "bronze_envelope",
    "hourly_energy",
    "curtailment_episodes",
    "notice_matches",
    "leakage_cube",
    "leakage_running",
    "statement_reconciliation",
    "upsert_latest_state",
    "silver_quality_checks",
    "facts_with_finance",
    "finance_consistency",
    "document_chunks",
    "retrieved_chunks",
    "routed_cases",
    "terminal_statuses",
    "daily_cost_mart",
    "run_facts",
    "stream_hourly_energy",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the engine and its Python workers.
    QUERIES["gold_leakage_fact"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
