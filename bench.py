"""Headline queries at $BENCH_SF_DIR and the published write and read workload, warm, on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from chronocell.catalogue import QUERIES
from chronocell.grid import Grid
from chronocell.sources.generators import generate_samples

NAMES = ("scan_range", "scan_ordered", "mvcc_latest", "mvcc_orders", "store_roundtrip", "count_per_tag", "map_reduce", "lambda_filter", "latest", "sum_daily", "avg_window_1800", "plan_upserts", "cell_stats", "djb2_hash", "gen_mock")
TAGS, SAMPLES, RUNS = 100, 86_400, 3


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    base = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.checkpoint.dir", f"{base}/work")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ran = lambda df: df.write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        runs = [timed(lambda: ran(QUERIES[name](spark, sf))) for _ in range(RUNS)]
        took[name] = round(statistics.median(runs), 3)
    # 100 tags of 86,400 samples, as the published programs write and read them
    rows, writes, merged, elided = TAGS * SAMPLES, [], [], []
    for i in range(RUNS):
        grid = Grid(spark, f"{base}/grid-{i}")
        writes.append(timed(lambda: grid.store(generate_samples(spark, TAGS, SAMPLES), 1, unique=True)))
        tags = list(range(TAGS))
        elided.append(timed(lambda: ran(grid.scan(tags, 0, SAMPLES * 1000))))
        merged.append(timed(lambda: ran(grid.scan(tags, 0, SAMPLES * 1000, assume_unique=False))))
        assert grid.scan(tags, 0, SAMPLES * 1000).count() == rows
    took |= {"write_8640000": round(statistics.median(writes), 3), "read_8640000": round(statistics.median(elided), 3), "read_merged_8640000": round(statistics.median(merged), 3)}
    per_second = {k: round(rows / took[f"{k}_8640000"]) for k in ("write", "read", "read_merged")}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_second": per_second, "sf": sf}))


if __name__ == "__main__":
    main()
