"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from hazemeter.plans.catalog import queries  # noqa: E402

HEADLINE = [
    "slice_sums", "aqi24_snapshots", "active_probes_wide", "aqi24_at_watermark_wide", "aqi5d",
    "city_lookup_distinct", "interval_join_range", "late_drop", "q1_top50", "q1_topk_wide",
    "q1_located", "q2_histogram", "q2_histogram_wide",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("hazemeter-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    run = lambda name: registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(names[0])  # starts the executors and warms the code paths all queries share

    def timed(name: str) -> float:
        begin = time.perf_counter()
        run(name)
        return round(time.perf_counter() - begin, 3)

    first = {name: timed(name) for name in names}
    second = {name: timed(name) for name in names}  # planned and compiled code is warm
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(first.values()), 3), "unit": "sec",
        "queries": first, "second_run": second, "second_total": round(sum(second.values()), 3),
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
