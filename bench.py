"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma-separated, or "all") the
queries. Each query runs once to warm up, then once timed; all its rows are computed and dropped.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "full_eda",
    "eda_sampled",
    "numeric_profile",
    "quartiles",
    "histogram",
    "outliers",
    "outlier_total",
    "correlation_pairs",
    "categorical_profile",
    "top_values",
    "unique_count",
    "entropy",
    "null_counts",
    "missing_values",
    "duplicate_rows",
    "memory_estimate",
    "systematic_sample",
    "infer_types",
    "scan_csv",
    "ingest_roundtrip",
    "filter_conjunction",
    "group_sum",
    "query_full",
    "query_sort",
    "sample_values",
    "quality_score",
    "catalog_list",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from rowlens.registry.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowlens bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total query time, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
