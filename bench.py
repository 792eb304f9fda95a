"""Seconds per headline query, warm, at $BENCH_SF_DIR on local[$BENCH_CPUS]. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidewarden.plans import QUERIES
from tidewarden.session import local_session

HEADLINE = (
    "status_latest",
    "status_history_10",
    "status_metrics",
    "parse_statuses",
    "alert_log_context",
    "event_rate",
    "consumer_lag",
    "topic_stat",
    "streak_verdicts",
    "probe_history_text",
    "throttle_greedy",
    "throttle_session",
    "edge_trigger",
    "stale_data_pager",
    "backlog_pager",
    "failed_job_pager",
    "silence",
    "damped_heartbeats",
    "partition_since",
    "counter_increase",
    "snapshot_non_zero",
    "pipe_min_time",
    "config_diff",
    "mail_digest",
    "mail_digest_parts",
    "udtf_checks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timings = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - began)
        seconds[name] = round(min(timings), 4)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
