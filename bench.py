"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. The first is run twice, to start Spark."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_revenue_by_nation",
    "primary_key_lookup",
    "count_rel_table",
    "extend_multi_rel",
    "rel_properties",
    "optional_match",
    "exists_subquery",
    "count_subquery",
    "cyclic_join",
    "distinct_rows",
    "order_skip_limit",
    "walk_var_length",
    "shortest_lengths",
    "path_functions",
    "functions_string",
    "vector_search",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from graphloom.graph_queries import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2 if name == HEADLINE[0] else 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
