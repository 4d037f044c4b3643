"""Purchase history: order lines with their order's context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.functions.prefix import running_sums

# Orders (or purchases) of one user that a single task sums; more are cut into chunks.
CHUNK = 1024


def order_interval_accu(orders: DataFrame) -> DataFrame:
    """Days since the user's first order, over all orders, the one to predict included."""
    days = F.coalesce(F.col("days_since_prior_order"), F.lit(0.0))
    return running_sums(
        orders,
        keys=["user_id"],
        order=[F.col("order_number")],
        chunk=F.floor(F.col("order_number") / CHUNK),
        values={"interval_accu": days},
    ).select(*orders.columns, "interval_accu")


def purchase_history(prior_lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Prior order lines with every column of their order but eval_set."""
    context = orders.filter(F.col("eval_set") == "prior").drop("eval_set")
    return prior_lines.select("order_id", "product_id", "reordered").join(context, "order_id")


def purchase_occurrence(history: DataFrame) -> DataFrame:
    """``order_time``: 0 for the user's first purchase of the product, 1 for the second, ..."""
    counted = running_sums(
        history,
        keys=["user_id", "product_id"],
        order=[F.col("order_number")],
        chunk=F.floor(F.col("order_number") / CHUNK),
        values={"_nth": F.lit(1)},
    )
    return counted.select(*history.columns, (F.col("_nth") - 1).alias("order_time"))


def user_product_last(history: DataFrame) -> DataFrame:
    """Order number and day count of each pair's last purchase."""
    return history.groupBy("user_id", "product_id").agg(
        F.max("order_number").alias("last_order_number"),
        F.max_by("interval_accu", "order_number").alias("interval_accu"),
    )
