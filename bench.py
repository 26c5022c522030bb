"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to Spark's noop sink RUNS times, of which the median counts, after one query to warm up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.chdir(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.getcwd())

from barkgraph.queries import queries  # noqa: E402
from barkgraph.session import local_session  # noqa: E402

HEADLINE = [
    "FLAGSHIP_profiles_by_video", "WN01_keep_best", "AG02_track_quality", "AG04_pair_metrics", "ST01_clusters", "JN03_event_candidates", "JN04_seen_windows", "JN10_interpolated_box",
    "AG11_predictions", "JN25_frame_events", "AG25_event_localization", "AG30_static_intervals", "ST03_fusion", "ST11_mot_metrics",
]
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    plans, took = queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS if took else RUNS + 1):  # the first query also warms the JVM up
            began = time.time()
            plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(times[-RUNS:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
