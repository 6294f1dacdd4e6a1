"""Benchmark: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with per-query wall seconds.

Every query is executed to completion through the ``noop`` sink (all rows
are produced, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "feature_frequency",       # flagship: profile + encode x3 + means
    "profile_metadata",
    "encode_table",
    "restore_table",
    "split_exact",
    "bootstrap",
    "roc_curve",
    "auc",
    "feature_distance",
    "nn_cross",
    "memorization",
    "membership_attack",
    "feature_effect",
    "train_test_comparison",
    "generate_copula",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from tabaudit.session import local_session
    from tabaudit.plans.catalog import REGISTRY
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)))
    # warm-up: JVM, Python workers and codegen caches
    REGISTRY["missing_indicator"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
