"""Headline queries, timed.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from molfold.plans import QUERIES  # noqa: E402

HEADLINE = (
    "p01_parse_atoms",
    "a08_library_statistics",
    "d09_descriptors",
    "f06_morgan_fingerprint",
    "f05_morgan_hashes",
    "k06_screen_library",
    "k01_threshold_search",
    "k02_topk_search",
    "k03_parallel_threshold_counts",
    "k07_multi_query_topk",
    "j01_similarity_matrix",
    "j03_pruned_all_pairs",
    "j03_similar_molecule_pairs",
    "j04_inverted_index",
    "g02_distance_matrix",
    "io01_smi_scan",
    "io07_descriptor_file",
    "r07_staged_screening",
    "w01_prefix_sum",
    "f02_hash_mix",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="molfold-bench-"))
        # kilobyte-sized shuffles still keep every core busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    # start the Python workers and compile the common plans before timing
    QUERIES["k06_screen_library"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
