"""User features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.config import USER_FEATURES
from encore.functions.columns import safe_div
from encore.operators.pairs import pair_grain


def order_grain(history: DataFrame) -> DataFrame:
    """Lines and reordered lines of each prior order."""
    return history.groupBy("user_id", "order_id", "order_number", "days_since_prior_order").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("reordered").alias("reorders")
    )


def user_level(pairs: DataFrame, per_order: DataFrame, *extra: Column) -> DataFrame:
    """Counts and averages of each user, undefined averages left NULL.

    Only users with a day gap and an order other than their first remain: with a single
    prior order there is nothing to tell how often they buy again.
    """
    from_pairs = pairs.groupBy("user_id").agg(
        F.sum("n").alias("user_nitems"),
        F.count(F.lit(1)).alias("user_ndistinctitems"),
        F.sum("n_reordered").alias("user_nritems"),
        F.count_if(F.col("n_reordered") > 0).alias("user_nrdistinctitems"),
        F.avg("n").alias("user_avg_prod_norder"),
        F.avg("order_gap").alias("user_order_gap"),
        F.avg("days_gap").alias("user_days_gap"),
        safe_div(F.count_if(F.col("n") >= 2), F.count(F.lit(1))).alias("user_second_order_rate"),
        *extra,
    )
    from_orders = per_order.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("user_norder"),
        F.max("order_number").alias("user_last_order"),
        F.avg("days_since_prior_order").alias("user_interval"),
        F.avg(
            F.when(F.col("order_number") != 1, F.col("reorders") / F.col("lines"))
        ).alias("user_avg_reorder_ratio"),
    )
    return from_pairs.join(
        from_orders.filter(
            F.col("user_interval").isNotNull() & F.col("user_avg_reorder_ratio").isNotNull()
        ),
        "user_id",
    )


def user_columns() -> dict[str, Column]:
    c = F.col
    per_order = safe_div(c("user_nitems"), c("user_norder"))
    reorders_per_order = safe_div(c("user_nritems"), c("user_norder") - 1)
    derived = {
        "user_order_interval_avg": F.coalesce(c("user_order_gap"), F.lit(0.0)),
        "user_days_interval_avg": F.coalesce(c("user_days_gap"), F.lit(0.0)),
        "user_nritem_ratio": safe_div(c("user_nritems"), c("user_nitems")),
        "user_nrdistinctitem_ratio":
            safe_div(c("user_nrdistinctitems"), c("user_ndistinctitems")),
        "user_nitem_per_order": per_order,
        "user_nritem_per_order": reorders_per_order,
        "user_nritem_per_order_ratio": safe_div(reorders_per_order, per_order),
    }
    return {name: derived.get(name, c(name)) for name in USER_FEATURES}


def user_features(history: DataFrame) -> DataFrame:
    """One row per user with at least two prior orders."""
    level = user_level(pair_grain(history), order_grain(history))
    return level.select("user_id", *[c.alias(name) for name, c in user_columns().items()])
