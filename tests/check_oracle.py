"""Run queries on Spark and DuckDB and compare them value by value.

    python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(frame):
    columns = sorted(frame.columns)
    rows = [
        tuple(None if v is None or v != v else v for v in row)
        for row in frame[columns].astype(object).itertuples(index=False, name=None)
    ]
    return columns, sorted(rows, key=lambda row: [(v is not None, v) for v in row])


def compare(spark_frame, duck_frame) -> str | None:
    """None if equal, else what differs. Values are compared exactly."""
    names, got = _sorted(spark_frame)
    expected_names, expected = _sorted(duck_frame)
    if names != expected_names:
        return f"columns {set(names) ^ set(expected_names)}"
    kinds = [(c, spark_frame[c].dtype, duck_frame[c].dtype) for c in names]
    # A column with NULLs has no integer type in pandas; both engines then give floats.
    odd = [k for k in kinds if k[1].kind != k[2].kind]
    if odd:
        return f"types {odd}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return str([(n, x, y) for n, x, y in zip(names, a, b) if x != y])
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from encore.plans import catalog, oracle

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle.oracle_sql(), 0
    for name, run in catalog.queries().items():
        if args and name not in args:
            continue
        started = time.time()
        try:
            frame = run(spark, sf_dir).toPandas()
            taken = time.time() - started
            if name in sql:
                started = time.time()
                expected = con.sql(sql[name]).df()
                problem = compare(frame, expected) or f"ok (duckdb {time.time() - started:.2f}s)"
            else:
                problem = "ok (no SQL)"
        except Exception as error:  # noqa: BLE001
            taken, problem, frame = 0, f"{type(error).__name__} {str(error)[:600]}", ()
        bad += not problem.startswith("ok")
        print(f"{name:32s} {taken:6.2f}s {len(frame):7d} {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
