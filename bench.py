"""Times the graph engine's headline queries, the median of three runs each; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from loomgraph.plans.queries import QUERIES

HEADLINE = ("expansion_cap", "ego_networks", "induced_arcs", "outward_paths", "compatible_patterns", "resource_allocation", "patterns_r1", "prune_domains", "weighted_pick", "expand_alloc", "validate_paths", "export_edges")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["graph_arcs"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
