"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "profile_distinct",
    "profile_numeric",
    "profile_top_values",
    "profile_text_length",
    "profile_full_orders",
    "quartiles_bracketed",
    "duplicate_counts_lineitem",
    "issues_missing",
    "issues_outliers_events",
    "issues_repeated_text",
    "issues_whitespace",
    "issues_all_orders",
    "score_overall",
    "clean_full",
    "clean_audit",
    "redact_text",
    "report_full",
    "window_counts",
    "rate_limit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM outside the clock
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
