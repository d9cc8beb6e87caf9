"""Times the headline queries and prints one line of JSON. Each query: the trimmed mean of five warm runs."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from larkgrid.operators.diagnostics import trimmed_mean
from larkgrid.queries import QUERIES

HEADLINE = ["grid_cumulative", "grid_argmin", "grid_dense_with_no_result", "single_pair_argmin", "many_identifiers", "predicate_funnel", "comparison_counters", "town_dictionary", "csv_ingest", "report_lines"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        seconds[name] = round(trimmed_mean(times[1:]), 4)  # the first run warms up
    spark.stop()
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
