"""Time the datasets and the main reports.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS] and prints one
JSON line: median seconds of three runs per query after one warm-up, plan building
included, and their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.registry import QUERIES
from railpulse.session import local_session

HEADLINE = (
    "txn_hourly_median", "bio_hourly_8d", "txn_hourly_health", "bio_hourly_health",
    "state_metrics", "state_10d_trend", "state_30d_trend", "bank_health", "bank_yesterday",
    "bank_yesterday_by_state", "bank_state_90d_trend", "health_score", "anomaly_count",
    "gtv_anomaly_k", "top_gainers", "top10_state_trend", "state_share_others",
    "state_variation", "state_threshold", "default_state_banks",
)


def seconds(build, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds(QUERIES[name], spark, sf_dir)
        timings[name] = round(
            statistics.median(seconds(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3
        )
    spark.stop()
    print(json.dumps({
        "metric": "payment health datasets and reports, total of medians",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
