"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from runlens.queries import all_queries  # noqa: E402
from runlens.session import build_session  # noqa: E402

HEADLINE = [
    "journal_bounds", "journal_retained", "cursor_resume", "run_sequence", "replay_buffer",
    "delivery_filter", "ndjson_export", "run_status", "run_outcome", "step_attempts",
    "event_counters", "value_histogram", "gauge_clamped", "latency_quantiles", "route_counts",
    "kv_latest", "kv_namespace_size", "kv_admission", "idem_lookup", "idem_ttl", "log_lines",
    "source_lines", "redacted_lines", "alias_resolve", "catalog_listing", "prefix_suggest",
    "arg_errors", "policy_decisions", "manifest_lint", "plan_table",
]
ROUNDS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        best = None
        for _ in range(ROUNDS):  # the first round compiles, the best one counts
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, best of two rounds each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
