"""Prints one JSON line: seconds of the headline queries, the median of three warm runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "reduce_left_join", "matched_cohort_intersection", "topk_per_group", "quantile_type2_grouped", "repeated_folds", "auc_pinned", "delong_ci",
    "delong_paired_z", "bootstrap_delta_auc", "bh_families", "cross_corr_long", "cross_corr_blocked", "two_sample_t_stats", "peel_bipartite", "permutation_search",
)
RUNS = 3


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans import registry

    seconds = {}
    for name in HEADLINE:
        f, took = registry.queries()[name], []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            f(spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
