"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names) may be set.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tipscope.plans.registry import queries  # noqa: E402
from tipscope.session import local_session  # noqa: E402

HEADLINE = (
    "market_features", "latest_features", "forward_label", "labeled_dataset", "burst_stats",
    "burst_history", "watchlist", "tip_columns", "document_tip_columns", "red_flags",
    "resolve_exact", "resolve_fuzzy", "resolve_tickers", "risk_scores", "average_precision",
    "roc_auc", "calibration_table", "temporal_split_counts", "serving_store", "upsert_latest",
    "file_calendar", "typed_daily_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    known, seconds = queries(), {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
