"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, default the headline list), BENCH_RUNS (best of, default 2).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from sparkwarden.plans.catalog import QUERIES

HEADLINE = [
    "search_page",
    "search_time_range",
    "text_search_all",
    "text_search_phrase",
    "word_postings",
    "overview",
    "top_source_ips",
    "heatmap_dense",
    "timeline",
    "graph_nodes",
    "recent_by_severity",
    "parse_auth",
    "parse_syslog",
    "validate_events",
    "fire_brute",
    "fire_scan",
    "fire_exfil",
    "rule_alerts",
    "rolling_count",
    "sudo_sequence",
    "port_scan_distinct",
    "exfil_deviation",
    "login_features",
    "dns_heuristic",
    "traffic_snapshots",
    "traffic_analysis",
    "login_forest_scores",
    "alerts_list",
    "cluster_narratives",
    "cluster_digest",
    "detect",
    "stream_brute",
    "detect_stream",
    "stream_rule_batches",
    "stream_rules",
    "text_index_search",
    "ingest_logs",
    "ingest_stream",
    "dns_forest",
    "traffic_forest_scores",
    "score_events",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    line = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(line))
    return 0


if __name__ == "__main__":
    sys.exit(main())
