"""Benchmark: time headline queries end to end on one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is fully computed into the ``noop`` sink (no collect).  Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from floe.plans.catalog import QUERIES  # noqa: E402
from floe.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_classification_report",
    "d1_stratified_split",
    "a1_median_impute",
    "j2_apply_params",
    "k5_soft_labels",
    "k10_blended_loss",
    "k14_three_term_loss",
    "k16_early_stopping",
    "e2_confusion",
    "e8_roc_curve",
    "e9_auc",
    "q1_causal_filter",
    "q7_residual_block",
    "k1_teacher_forest",
    "k4_distilled_student",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", max(8, 2 * cpus), "floe-bench",
                          {"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up (JVM start, JIT, planner) on the smallest data set, so nothing of
    # the measured scale is cached
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        QUERIES["flagship_classification_report"](spark, warm).write.format("noop").mode("overwrite").save()
    QUERIES["a7_class_support"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
