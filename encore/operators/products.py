"""Product features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.config import PRODUCT_FEATURES, FeatureParams
from encore.functions.columns import safe_div
from encore.operators.pairs import pair_grain


def product_level(pairs: DataFrame) -> DataFrame:
    """Counts and averages of each product. Pairs are unique, so users are just rows.

    A product that everybody buys is no hot key: the aggregates have a map-side part.
    """
    return pairs.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("prod_nuser"),
        F.sum("n").alias("prod_norder"),
        F.count_if(F.col("n_reordered") > 0).alias("prod_nruser"),
        F.sum("n_reordered").alias("prod_nrorder"),
        F.avg("days_gap").alias("prod_days_gap"),
        F.avg("order_gap").alias("prod_order_gap"),
        safe_div(F.count_if(F.col("n") >= 2), F.count(F.lit(1))).alias("prod_second_order_ratio"),
    )


def product_columns(p: FeatureParams) -> dict[str, Column]:
    c = F.col
    derived = {
        "prod_days_interval_avg": F.coalesce(c("prod_days_gap"), F.lit(p.days_gap)),
        "prod_order_interval_avg": F.coalesce(c("prod_order_gap"), F.lit(p.order_gap)),
        "prod_ruser_ratio": safe_div(c("prod_nruser"), c("prod_nuser")),
        "prod_rorder_ratio": safe_div(c("prod_nrorder"), c("prod_norder")),
        "prod_rorder_per_ruser":
            F.coalesce(safe_div(c("prod_nrorder"), c("prod_nruser")), F.lit(0.0)),
        "prod_order_per_user": safe_div(c("prod_norder"), c("prod_nuser")),
    }
    return {name: derived.get(name, c(name)) for name in PRODUCT_FEATURES}


def product_features(history: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """One row per product of the history."""
    level = product_level(pair_grain(history))
    return level.select("product_id", *[c.alias(n) for n, c in product_columns(params).items()])
