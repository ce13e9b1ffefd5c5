"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores. Each query runs into the no-op sink after one untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "d3_move_metrics",
    "d2_dense_rollup",
    "d5_thin_bars",
    "b9_all_pillars",
    "e6_percentile_rank",
    "e12_push_decision",
    "d13_evaluation_summary",
    "d19_whatif_sweep",
    "c1_asof_reference",
    "c3_asof_news",
    "c9_interval_overlap",
    "c8_days_since_reverse_split",
    "d11_outcomes",
    "d6_volume_baseline",
    "d21_nearest_rank_percentile",
    "l1_runner_detection",
    "l2_miss_diagnosis",
    "b17_retention_class",
    "c17_pruned_snapshots",
    "d30_pillar_base_rates",
    "e11_change_only",
    "l4_listing_lifecycle",
    "a12_bar_records",
    "k1_window_poll",
)


def main() -> None:
    from tapeloom.session import build_session
    from tapeloom.suite import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("bench", f"local[{cpus}]", int(cpus), {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["d4_session_dollar_volume"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
