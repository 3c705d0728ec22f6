"""Times the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from plait.queries import QUERIES

NAMES = ["inner_eq", "left_eq", "full_eq", "right_eq", "left_eq_fact", "chain3", "chain4", "date_full", "semi_eq", "anti_eq", "asof_ge", "rewrite_associate", "strategy_grace_inner", "strategy_merge_full", "matrix_inner_le", "point_lookup", "range_lookup", "stats_orders", "stats_ndv"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("plait-bench")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        best = None
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - began
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total of best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
