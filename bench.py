"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` picks the data folder, ``BENCH_CPUS`` the number of threads, ``BENCH_KEYS`` a
comma-separated choice of queries.  Each query runs twice; the second run counts.  The whole
result is computed through a ``noop`` write.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload import QUERIES  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k] or list(QUERIES)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("stepframe-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for key in keys:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total warm seconds over all queries",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
