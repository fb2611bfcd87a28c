"""Times of the headline queries: one warm-up of the session, then the median of RUNS runs each."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HEADLINE = [
    "change_region_stats",
    "change_cell_interval",
    "interval_hot_fraction",
    "strongest_interval",
    "activity_tertile",
    "variance_threshold",
    "cell_state_summary",
    "region_filter_evidence_any",
    "region_filter_active_period",
    "behaviour_counts",
    "dominant_class",
    "class_transitions",
    "class_history_outcome",
    "timeline_table",
    "interval_pivot",
    "series_domain",
    "change_ramp",
    "capture_dedupe",
    "capture_top_draw",
    "capture_nearest",
    "capture_nearest_sorted",
    "search_ids_places",
    "session_last_event",
    "latest_request_wins",
    "window_results",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from terradelta import catalog
    from terradelta.session import session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            catalog.FOUND[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
