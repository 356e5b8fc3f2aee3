"""Time the headline queries: one JSON line with seconds per query and their sum."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulseframe.session import build_session  # noqa: E402
from pulseframe.verification.queries import all_queries  # noqa: E402

HEADLINES = (
    "a1_daily_reduce",
    "a2_daily_pivot",
    "f5_overview",
    "w3_rolling_zscore",
    "a3_correlation_pairs",
    "a9_correlation_matrix",
    "a10_heatmap",
    "o4_top_pairs",
    "c4_user_stats",
    "r1_overview",
    "r2_correlations",
    "r3_narrative",
    "r4_report",
    "s1_apple",
    "s2_fitbit_activity",
    "s4_google",
    "u1_union_sources",
    "t2_refresh",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "pulseframe-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            # Few but costly rows: keep all cores busy rather than merge small partitions.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    registered["a5_event_count"](spark, folder).collect()
    seconds = {}
    for name in HEADLINES:
        best = None
        for _ in range(2):
            started = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - started
            best = elapsed if best is None else min(best, elapsed)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
