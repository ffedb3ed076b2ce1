"""Time the registered queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs after one warm-up, default 3; the median counts) and
BENCH_QUERIES (comma list, default the headline queries; ``all`` for every one).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablesteward.session import local_session  # noqa: E402
from tablesteward.workload.registry import QUERIES  # noqa: E402

HEADLINE = (
    "catalog_tables", "column_logical_bytes", "schema_cards", "index_diff", "index_upsert", "embed_input", "embed_hash_tf",
    "knn_cosine", "retrieve_distinct", "sql_mask", "sql_verdict", "sql_audit_report", "scan_cost_report", "governed_topk",
    "governed_join", "governed_rollup", "json_safe_scalars", "json_safe_nested", "derive_column", "period_change",
    "calendar_columns", "event_log", "session_state", "recent_events", "session_preview", "session_purge", "stream_sessions",
    "invocation_fold", "trajectory_score", "golden_rank_check", "truncate_marked", "trace_rollup", "call_gap_audit",
    "paced_release",
)


def run_once(spark, name: str, sf_dir: str) -> float:
    """Build the query and have every column of every row computed."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(cpus, "bench", **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        run_once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cpus,
        "driver_memory": spark.conf.get("spark.driver.memory"),
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }
    spark.stop()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
