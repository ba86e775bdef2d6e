"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
A query counts from its call to the end of a write that goes nowhere; each runs once to compile code
and once for the figure.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from wayloom.plans import catalogue

HEADLINE = ["merged_junctions", "dual_edges", "secondary_components", "merge_edges", "junction_edges_roles", "report_row", "csr_rows", "synthetic_multiply",
            "morton_decode", "geodetic_to_enu", "interval_coalesce", "attr_query_union", "routing_summary", "link_end_classification", "knn_lanes", "shortest_path_lengths"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took, queries = {}, catalogue.queries()
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "complex_junction_detection", "value": took["merged_junctions"], "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
