"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 4):
each query is run once to warm up, then BENCH_RUNS times; its figure is the median.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from batchwright.plans import QUERIES  # noqa: E402

HEADLINE = (
    "sum_product",
    "sum_product_filtered",
    "row_count",
    "group_means",
    "group_summary",
    "dedupe_first",
    "dedupe_report",
    "duplicate_groups",
    "duplicate_members",
    "multiplicity_histogram",
    "top_k",
    "page_deep",
    "bulk_read_parquet",
    "feather_roundtrip",
    "arrow_stream_roundtrip",
    "scan_batches",
    "partitioned_scan",
    "envelope_roundtrip",
    "json_dir_read",
    "normalize_records",
    "validate_records",
    "append_positional",
    "append_skip",
    "append_conflicts",
    "synth_production",
    "stream_append",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "4"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
