"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice: "first" has the seconds of the first run, "queries" those of the second, when code is compiled.
What queries read from the shared folder (postings, cells of vectors) is built before them and timed apart as "build";
"first_with_builds" is the sum of builds and first runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent))
from lodeseek.cluster import ship_code  # noqa: E402
from lodeseek.plans import QUERIES, retrieval  # noqa: E402

HEADLINE = ["postings_stats", "bm25_topk", "vector_topk", "hybrid_search", "citations", "ann_cells", "line_elements", "l1_packing", "dedup_decision", "path_resolution", "task_state", "history_window"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_code(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    names = sys.argv[1:] or HEADLINE

    def seconds(f) -> float:
        began = time.time()
        f()
        return round(time.time() - began, 3)

    build = {"postings": seconds(lambda: retrieval.index_of(spark, sf_dir)), "cells": seconds(lambda: retrieval.cells_of(spark, sf_dir))}
    first, took = {}, {}
    for name in names:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        first[name], took[name] = seconds(run), seconds(run)
        print(name, first[name], took[name], file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first": first, "build": build, "first_with_builds": round(sum(first.values()) + sum(build.values()), 3), "median": round(statistics.median(took.values()), 3), "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
