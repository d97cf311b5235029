"""Times the engine's queries; prints one line of JSON. Environment: BENCH_SF_DIR, BENCH_CPUS.

Queries that first build what a store would keep (an index, a cube, a tree, a warehouse, files to read) are timed
too, under `builds`, and not in the total: most of their time is the build.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from sparkvista.plans.queries import BUILDS, QUERIES


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["city_ratings_month"](spark, sf_dir).collect()  # compiled code and file listings
    took: dict[str, float] = {}
    for name, query in QUERIES.items():
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([\d.]+)$", sf_dir.rstrip("/"))
    builds = {name: took.pop(name) for name in BUILDS}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "builds": builds, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
