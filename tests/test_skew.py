"""One user and one product with a third of the rows: the joins must be ones Spark can split."""

import pytest
from pyspark.sql import functions as F

from encore.operators import matrix, pairs
from encore.session import materialise

SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "20",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def skewed(spark):
    before = {key: spark.conf.get(key) for key in SKEWED}
    for key, value in SKEWED.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def split_joins(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


def test_pairs_of_a_hot_product_and_a_hot_user(skewed):
    n = 60_000
    row = F.col("id")
    history = skewed.range(0, n, 1, 8).select(
        row.alias("order_id"),
        F.when(row % 3 == 0, 1).otherwise(row % 5000).cast("long").alias("product_id"),
        F.when(row % 3 == 1, 7).otherwise(row).cast("long").alias("user_id"),
        (row % 4).cast("int").alias("order_number"), F.lit(1).alias("reordered"),
        F.lit(1).alias("order_dow"), F.lit(1).alias("order_hour_of_day"),
        F.lit(3.0).alias("days_since_prior_order"), F.lit(9.0).alias("interval_accu"))
    history = materialise(history, "skewed")
    assert split_joins(pairs.user_product_features(history)) > 0


def test_orders_of_a_hot_user(skewed):
    row = F.col("id")
    orders = skewed.range(0, 60_000, 1, 8).select(
        row.alias("order_id"), F.when(row % 3 == 0, -7).otherwise(row).cast("long").alias("user_id"),
        F.when((row % 3 > 0) | (row == 0), "train").otherwise("prior").alias("eval_set"),
        (row % 4).cast("int").alias("order_number"), (row % 7).cast("int").alias("order_dow"),
        (row % 24).cast("int").alias("order_hour_of_day"), F.lit(3.0).alias("days_since_prior_order"),
        F.lit(9.0).alias("interval_accu"))
    orders = materialise(orders, "skewed")
    wanted = materialise(matrix.single_targets(orders), "targets")
    assert split_joins(matrix.toward_target(orders, wanted)) > 0
