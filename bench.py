"""Benchmark: run the headline queries on $BENCH_SF_DIR and print one JSON line.

Each query is executed to completion through the ``noop`` sink (the full plan
runs, nothing is collected to the driver).  Env:
  BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
  BENCH_CPUS     local[N] (default: all cores)
  BENCH_QUERIES  optional comma-separated subset
  BENCH_EVENT_LOG optional folder for Spark's event log (stage/task times)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prepare_corpus",        # E1 flagship: label, parse, render, folds, semi-join, dedup, joins, union
    "pair_win_counts",       # A1 pair priors
    "pair_prior_join",       # J5 + T25 prior adjustment
    "stratified_kfold",      # W1 skew-safe numbering
    "render_turns",          # T4 templates over parsed lists
    "dedup_keep_first",      # U4
    "eval_metrics",          # ML9 log loss / accuracy / balanced accuracy
    "binned_mean_loss",      # T28 + A10 exact qcut
    "temperature_search",    # A15 per-bin grid
    "blend_grid_search",     # A14 coarse-to-fine blend
    "knn_top1_join",         # J6 exact pruned kNN
    "inject_context",        # J4 + T15 retrieval context
    "scan_result_jsonl",     # S7 nested JSON source
    "turn_parity_check",     # T19 + F5
    "running_mean_loss",     # W5 bucketed running aggregate
    "early_stop_round",      # W7
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    wanted = os.environ.get("BENCH_QUERIES")
    names = [q for q in HEADLINE if not wanted or q in wanted.split(",")]

    from rivalry.plans import registry
    from rivalry.session import build_session
    try:
        ram_gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    except (ValueError, OSError):
        ram_gb = 8.0
    default_mem = f"{max(1, min(8, int(ram_gb * 0.6)))}g"  # leave room for Python workers
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", default_mem)}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="rivalry-bench",
                          extra=extra)
    registry.load_all()
    from rivalry.session import ship_package
    ship_package(spark)
    # warm-up: JVM, codegen caches, the Parquet write path and the Python worker pool
    from rivalry.session import cut_lineage
    spark.range(1000).selectExpr("sum(id)").collect()
    cut_lineage(spark.range(1000).selectExpr("id", "cast(id as string) AS s"), "bench-warmup").count()
    registry.QUERIES["log_loss"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
