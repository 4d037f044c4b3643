"""Wall time of the headline queries; prints one JSON line.

The raw tables are turned into canonical ones once (``canonical_tables``, timed like a
query); the other queries then start from these, as a user's would. Every query runs once to
warm up and BENCH_REPEAT times to be timed; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from encore.plans.catalog import QUERIES, Retail  # noqa: E402

HEADLINE = [
    "user_features", "product_features", "user_product_features", "target_order_features",
    "time_features", "id_features", "feature_matrix_train", "feature_matrix_test",
    "legacy_matrix", "user_affinity", "roc_auc", "threshold_sweep", "best_threshold_exact",
    "ensemble_vote", "submission",
]
STORED = ("orders", "accu_orders", "purchases", "accu_history", "products")


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(spark: SparkSession, sf_dir: str) -> Retail:
    """Store the canonical tables; everything else derives from them."""
    tables = Retail(spark, sf_dir, store=True)
    for name in STORED:
        getattr(tables, name)
    return tables


def fresh(tables: Retail) -> Retail:
    """The stored tables without anything derived from them."""
    copy = object.__new__(Retail)
    kept = ("spark", "store", "star", "layer", *STORED)
    copy.__dict__.update({name: tables.__dict__[name] for name in kept})
    return copy


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}

    canonical(spark, sf_dir)
    seconds["canonical_tables"] = statistics.median(
        timed(lambda: canonical(spark, sf_dir)) for _ in range(repeat)
    )
    tables = canonical(spark, sf_dir)
    for name in HEADLINE:
        def run(name=name):
            QUERIES[name](fresh(tables)).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = statistics.median(timed(run) for _ in range(repeat))
        print(f"{name}: {seconds[name]:.2f}s", file=sys.stderr, flush=True)

    seconds = {name: round(value, 3) for name, value in seconds.items()}
    print(json.dumps({
        "metric": "total_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))


if __name__ == "__main__":
    main()
