"""Session settings, scratch space and materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Run-time settings the plans count on. Skewed joins are split even where the split costs
# an extra exchange, because one key may hold a large part of all rows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
CHECKPOINT_DIR = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; sizes and partition counts stay with the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset on a single machine is a temporary folder taken, once per session.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="encore-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/encore/{name}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(spark, "checkpoints"))


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a frame with several consumers once, and read it back column by column.

    Each consumer needs other columns, so Spark would not share the exchange below and would
    run the joins again for each. The table is also a lineage cut: a lost executor costs
    re-reads, not re-joins. ``by`` names a column of few values that consumers filter on; rows
    are then stored by it and the other values are not read.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
