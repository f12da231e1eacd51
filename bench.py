"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "metrics_minimum_slice", "metrics_all", "equal_weight_rollup", "select_params", "clean_control", "test_of_selected", "all_families", "resolvent_t16",
    "cubic_t16", "gaussian_s4", "median_w9", "strata_counts", "noise_correlated", "coverage", "discovery_features", "ancestry_roots", "structural_diff", "manifest_verify",
    "long_runs_smoothing", "scenario_jitter", "scenario_correlated",
)


def main() -> None:
    from flicker.registry import QUERIES
    from flicker.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    for name in ("series_from_events", "cubic_t16"):  # start the JVM's code, and the Python workers
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, warm_up = {}, round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "warm_up": warm_up, "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
