"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from lodescan.session import build_session, clean_run

HEADLINE = [
    "page_facts", "page_text", "site_scorecard", "summary_audit", "site_digests",
    "sitemap_total", "crawl_plan_12", "deep_report", "findings_clean", "lead_summary",
    "intake_long", "request_meta", "daily_cap", "guard_limits", "trailing_hits",
    "stream_soft_limit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in os.environ.get("BENCH_ONLY", "").split() or HEADLINE:
        best = None
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    result = {
        "metric": "headline queries, best of runs, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }
    for name, rows in (("page_facts", pages), ("page_text", pages), ("daily_cap", events)):
        if name in seconds:
            result[f"{name}_rows_per_sec"] = round(rows / seconds[name], 1)
    clean_run(spark)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
