"""Time the headline queries and print one JSON line.

Each query is built anew and run to the end (every row and column is computed and
thrown away) once to warm up and then three times; the median is reported.
Building the expression and planning are part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkbar.plans.queries import QUERIES

HEADLINES = (
    "detect_regex_only",
    "detect_regex_only_pages",
    "redact",
    "redact_response",
    "detect_distinct_once",
    "mark_cached",
    "span_report",
    "entity_counts",
    "sweep_non_overlapping",
    "drop_overlapping_existing",
    "redact_with_external_spans",
    "latency_percentiles",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("inkbar-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="inkbar-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chars = (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .agg(F.sum(F.length("text").cast("long")))
        .first()[0]
    )
    took: dict[str, float] = {}
    for name in HEADLINES:
        times = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "chars": chars,
                "detect_chars_per_s": round(chars / took["detect_regex_only"]),
                "redact_chars_per_s": round(chars / took["redact"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
