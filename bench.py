"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rowmend.plans import catalog  # noqa: E402

HEADLINE = [
    "table_overview", "numeric_describe", "category_distribution", "target_check", "label_encode",
    "stratified_split", "roc_auc", "select_threshold", "metric_report", "latest_per_key",
    "knn_join", "gower_distance", "neighbour_consensus", "apply_suggestions", "greedy_repair",
    "fit_detector", "score_rows", "batch_detect_trained", "attribute_rows", "isolation_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rowmend-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="rowmend-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    # Starts the JVM code paths and the Python workers before anything is timed.
    queries["knn_join"](spark, "/root/testdata/sf0.001").count()
    times = {}
    for name in names:
        began = time.monotonic()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
