"""Time the headline queries: one JSON line with the median of three warm runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import PLANS  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "tumbling_1m", "tumbling_1h_by_type", "asof_last_view", "asof_account_master", "route_split", "route_overlap",
    "topic_router", "dlq_split", "dlq_envelope", "compact_latest", "apply_changes", "version_history", "dedupe_versions",
    "resolved_gate", "retention_by_tier", "rate_5m", "increase_15m", "rate_lookback", "state_history", "histogram_p95",
    "latest_by_group", "percentile_p95", "alerts_sustained", "auth_bursts", "outside_windows", "dr_status",
    "check_name_parts", "plan_bindings", "compat_backward_transitive", "encrypt_roundtrip", "reconcile_roundtrip",
    "offset_lag", "upsert_table", "stream_tumbling_1h", "stream_asof", "stream_resolved_gate", "stream_late_split",
    "compat_backward", "compat_full_transitive", "throughput_in_out", "lag_in_seconds", "dlq_rate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "tidemark-bench")
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "total of median warm query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores, "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
