"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wildgrid.plans import catalogue  # noqa: E402
from wildgrid.session import build_session  # noqa: E402

HEADLINES = [
    "enriched_month_profile", "dedupe_keep_first", "resume_anti_join", "keyword_route_bad",
    "cleaning_flow_good", "local_time", "weather_snapshots", "payload_hour_lookup", "zone_of_point",
    "land_flag", "daylight_flag", "nearest_centroid", "observation_features", "class_size_filter",
    "group_mean_impute", "month_pivot_filled", "level_counts", "describe_numeric", "histogram10",
    "mean_interval", "stratified_holdout_nulls", "stratified_folds", "ordered_folds", "oversample_counts",
    "class_report", "method_accuracy", "report_diff", "mean_image_probs", "cascade_results",
    "cascade_error_rate", "silhouette_fixed", "standardised",
]
# Fits, streams and files: timed apart, so that the total stays comparable between rounds.
JOBS = ["kmeans_best_k", "tune_tree", "node_sweep", "model_cascade", "enrich_stream", "file_order_first"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalogue.load()
    seconds, cold = {}, {}
    for name in HEADLINES + JOBS:
        for times in (cold, seconds):  # the first run also compiles code and fills file caches
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds[n] for n in HEADLINES), 3),
                      "jobs_total": round(sum(seconds[n] for n in JOBS), 3),
                      "unit": "sec", "queries": seconds, "cold": cold, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
