"""The user x product grain: one row per pair, from which every other block rolls up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.config import USER_PRODUCT_FEATURES, FeatureParams
from encore.functions.columns import flag, safe_div
from encore.session import materialise


def pair_aggregates() -> list[Column]:
    """Aggregates of one pair's purchases. Rows without an order number count for nothing."""
    return [
        F.count("order_number").alias("n"),
        F.coalesce(F.count_if(F.col("reordered") == 1), F.lit(0)).alias("n_reordered"),
        F.max("reordered").alias("any_reordered"),
        F.min("order_number").alias("first_order"),
        F.max("order_number").alias("last_order"),
        F.min("interval_accu").alias("first_days"),
        F.max("interval_accu").alias("most_days"),
        F.max_by("interval_accu", "order_number").alias("last_days"),
    ]


def with_gaps(pairs: DataFrame) -> DataFrame:
    """Mean order and day gap between purchases of the pair; NULL for a single purchase."""
    return pairs.withColumns({
        "order_gap": safe_div(F.col("last_order") - F.col("first_order"), F.col("n") - 1),
        "days_gap": safe_div(F.col("most_days") - F.col("first_days"), F.col("n") - 1),
    })


def pair_grain(history: DataFrame) -> DataFrame:
    """(order_id, product_id) is unique, so distinct orders of a pair are just its rows."""
    return with_gaps(history.groupBy("user_id", "product_id").agg(*pair_aggregates()))


def user_product_columns(p: FeatureParams) -> dict[str, Column]:
    """Over pair columns, ``user_*`` and ``prod_*`` averages still NULL where undefined.

    The filled gap is divided by the unfilled average, and both day ratios divide by the
    average *order* gap: odd, but results depend on it.
    """
    order_gap = F.coalesce(F.col("order_gap"), F.lit(p.order_gap))
    days_gap = F.coalesce(F.col("days_gap"), F.lit(p.days_gap))

    def ratio(gap: Column, average: str, missing: float) -> Column:
        return F.coalesce(safe_div(gap, F.col(average)), F.lit(missing))

    rate = safe_div(F.col("n") - 1, F.col("user_norder") - F.col("first_order"))
    columns = {
        "user_prod_norder": F.col("n"),
        "user_prod_order_interval": order_gap,
        "user_prod_days_interval": days_gap,
        "user_prod_reorder_rate": F.coalesce(rate, F.lit(0.0)),
        "user_prod_reordered": F.col("any_reordered"),
        "user_prod_recentlydiscovered": flag(F.col("first_order") == F.col("user_last_order")),
        "user_prod_order_interval_user_ratio":
            ratio(order_gap, "user_order_gap", p.order_ratio),
        "user_prod_order_interval_prod_ratio":
            ratio(order_gap, "prod_order_gap", p.order_ratio),
        "user_prod_days_interval_user_ratio":
            ratio(days_gap, "user_order_gap", p.days_ratio),
        "user_prod_days_interval_prod_ratio":
            ratio(days_gap, "prod_order_gap", p.days_ratio),
        "user_prod_norder_user_ratio": safe_div(F.col("n"), F.col("user_avg_prod_norder")),
    }
    return {name: columns[name] for name in USER_PRODUCT_FEATURES}


def user_product_features(history: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """One row per pair a user has bought; pairs are stored, as three branches read them."""
    pairs = materialise(pair_grain(history), "pairs")
    # max(order_number) is the latest prior order; distinct orders come from the order ids.
    users = pairs.groupBy("user_id").agg(
        F.avg("n").alias("user_avg_prod_norder"),
        F.avg("order_gap").alias("user_order_gap"),
        F.max("last_order").alias("user_last_order"),
    )
    norder = (
        history.select("user_id", "order_id").distinct()
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("user_norder"))
    )
    products = pairs.groupBy("product_id").agg(F.avg("order_gap").alias("prod_order_gap"))
    # Stored, so that both joins can be split where one user or product has very many pairs.
    users = materialise(users.join(norder, "user_id"), "pair-users")
    products = materialise(products, "pair-products")
    return (
        pairs.join(users, "user_id").join(products, "product_id")
        .select(
            "user_id",
            "product_id",
            *[c.alias(name) for name, c in user_product_columns(params).items()],
        )
    )
