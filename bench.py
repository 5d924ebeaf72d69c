"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans.catalog import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = [
    "window_features_tumbling",
    "window_features_sliding",
    "window_context_and_labels",
    "median_and_mad_large_blocks",
    "unit_conversion",
    "unpivot_measures",
    "first_copies_kept",
    "segments_by_label_and_gap",
    "duplicate_observations",
    "interval_annotation",
    "interval_annotation_with_nearest",
    "window_event_overlap",
    "event_interval_summary",
    "window_metrics_by_class",
    "threshold_sweep",
    "bootstrap_event_rate",
    "robust_scaling",
    "tail_errors",
    "empirical_cdf",
    "subspace_reconstruction",
    "isolation_forest_scores",
    "explained_predictions",
    "stream_closed_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
