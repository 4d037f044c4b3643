"""Features of the order to predict, seen from the user's earlier purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.config import KEYS, TARGET_FEATURES, FeatureParams
from encore.functions.columns import safe_div
from encore.operators.pairs import pair_grain
from encore.operators.users import order_grain, user_level
from encore.session import materialise


def target_orders(orders: DataFrame, eval_set: str | None = None) -> DataFrame:
    """The orders to predict. ``orders`` comes with ``interval_accu``."""
    wanted = (
        F.col("eval_set") != "prior" if eval_set is None else F.col("eval_set") == eval_set
    )
    return orders.filter(wanted).select(
        "order_id",
        "user_id",
        "eval_set",
        F.col("order_number").alias("target_number"),
        F.col("order_dow").alias("target_dow"),
        F.col("order_hour_of_day").alias("target_hour"),
        F.col("days_since_prior_order").alias("target_interval"),
        F.col("interval_accu").alias("target_days"),
    )


def target_columns(p: FeatureParams) -> dict[str, Column]:
    """Over pair, user and target columns."""
    c = F.col
    orders_ago = c("target_number") - c("last_order")
    days_ago = c("target_days") - c("last_days")
    order_gap = F.coalesce(c("order_gap"), F.lit(p.order_gap))
    days_gap = F.coalesce(c("days_gap"), F.lit(p.days_gap))
    missing = F.lit(p.rate_ratio)
    columns = {
        "user_lastorder_interval": c("target_interval"),
        "user_lastorder_interval_ratio":
            F.coalesce(safe_div(c("target_interval"), c("user_interval")), missing),
        "user_prod_lastorder_interval": orders_ago,
        "user_prod_lastdays_interval": days_ago,
        "user_prod_lastorder_interval_rate": safe_div(orders_ago, order_gap),
        "user_prod_lastdays_interval_rate": F.coalesce(safe_div(days_ago, days_gap), missing),
    }
    return {name: columns[name] for name in TARGET_FEATURES}


def target_order_features(
    candidates: DataFrame,
    orders: DataFrame,
    history: DataFrame,
    params: FeatureParams = FeatureParams(),
) -> DataFrame:
    """One row per candidate; ``orders`` and ``history`` come with ``interval_accu``."""
    pairs = materialise(pair_grain(history), "pairs")
    users = user_level(pairs, order_grain(history)).select("user_id", "user_interval")
    return (
        candidates.select(*KEYS)
        .join(target_orders(orders).join(users, "user_id"), ["order_id", "user_id"])
        .join(pairs, ["user_id", "product_id"])
        .select(*KEYS, *[col.alias(name) for name, col in target_columns(params).items()])
    )
