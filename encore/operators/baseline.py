"""A score that needs no model: how often a user bought the product since first buying it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.config import KEYS
from encore.functions.columns import safe_div


def _pairs(history: DataFrame) -> DataFrame:
    return history.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("order_number").alias("first")
    )


def _with_rate(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``pred_prob`` to pairs, in a join over the user alone."""
    orders = (
        history.select("user_id", "order_id").distinct()
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"))
    )
    rate = safe_div(F.col("n") - 1, F.col("orders") - F.col("first"))
    return pairs.join(orders, "user_id").withColumn("pred_prob", F.coalesce(rate, F.lit(0.0)))


def reorder_rate(history: DataFrame) -> DataFrame:
    """(n - 1) / (orders - first order) of each pair, 0 where undefined."""
    return _with_rate(_pairs(history), history).select("user_id", "product_id", "pred_prob")


def reorder_rate_scores(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates (with their label, if they have one) and the reorder rate as ``pred_prob``.

    Candidates meet the pairs where these were counted; only what is left is moved to its user's orders.
    """
    labels = [name for name in candidates.columns if name not in KEYS]
    pairs = candidates.join(_pairs(history), ["user_id", "product_id"])
    return _with_rate(pairs, history).select(*KEYS, *labels, "pred_prob")
