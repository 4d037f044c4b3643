"""How purchases spread over the days of the week and the hours of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.config import KEYS, TIME_FEATURES, FeatureParams
from encore.functions.columns import count_or_zero, safe_div, smoothed
from encore.session import materialise


def line_counts(history: DataFrame, keys: list[str], count: str, reorders: str | None = None) -> DataFrame:
    """Lines per key, and reordered lines in the same pass if they are given a name."""
    columns = [F.count(F.lit(1)).alias(count)]
    if reorders:
        columns.append(F.count_if(F.col("reordered") == 1).alias(reorders))
    return history.groupBy(*keys).agg(*columns)


def reorder_counts(history: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Reordered lines per key; keys without any have no row."""
    return (
        history.filter(F.col("reordered") == 1).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(name))
    )


def time_cube(history: DataFrame) -> DataFrame:
    """Lines and reorders per product, day and hour; all product and time counts add up from it."""
    return line_counts(
        history, ["product_id", "order_dow", "order_hour_of_day"], "cnt", "rcnt"
    )


def slot_totals(cube: DataFrame, slot: str, name: str) -> DataFrame:
    """Lines per hour or per day over all products: at most 24 or 7 rows."""
    return cube.groupBy(slot).agg(F.sum("cnt").alias(name))


def product_profile(cube: DataFrame) -> DataFrame:
    """One row per product: its totals, and its counts by hour and by day as two small maps.

    The maps hold at most 24 and 7 entries. They let a candidate fetch the counts of its own
    day and hour with one join on product_id, not with one join per kind of count.
    """

    def by(slot: str, name: str) -> DataFrame:
        slots = cube.groupBy("product_id", slot).agg(
            F.sum("cnt").alias("cnt"), F.sum("rcnt").alias("rcnt")
        )
        entry = F.struct(F.col(slot), F.struct("cnt", "rcnt"))
        return slots.groupBy("product_id").agg(
            F.map_from_entries(F.collect_list(entry)).alias(name),
            F.sum("cnt").alias(f"{name}_cnt"),
            F.sum("rcnt").alias(f"{name}_rcnt"),
        )

    return by("order_hour_of_day", "by_hour").join(by("order_dow", "by_dow"), "product_id").select(
        "product_id",
        "by_hour",
        "by_dow",
        F.col("by_dow_cnt").alias("prod_cnt"),
        F.col("by_dow_rcnt").alias("prod_rcnt"),
    )


def with_slot_counts(rows: DataFrame) -> DataFrame:
    """Counts of the target's hour and day, looked up in the product's maps."""
    hour = F.col("by_hour")[F.col("target_hour")]
    day = F.col("by_dow")[F.col("target_dow")]
    return rows.withColumns({
        "prod_hour_cnt": hour["cnt"],
        "prod_hour_rcnt": hour["rcnt"],
        "prod_week_cnt": day["cnt"],
        "prod_week_rcnt": day["rcnt"],
    }).drop("by_hour", "by_dow")


def time_columns(p: FeatureParams) -> dict[str, Column]:
    """Over the counts; a slot nobody has ever bought in has no share (NULL)."""
    c = F.col

    def at(n: str, d: str, k: int) -> Column:
        return smoothed(c(n), c(d), k)

    columns = {
        "order_dow": c("target_dow"),
        "order_hour_of_day": c("target_hour"),
        "prod_hour_prob": safe_div(count_or_zero(c("prod_hour_cnt")), c("hour_cnt")),
        "prod_week_prob": safe_div(count_or_zero(c("prod_week_cnt")), c("week_cnt")),
        "week_prod_prob": at("prod_week_cnt", "prod_cnt", p.dow_given_product),
        "hour_prod_prob": at("prod_hour_cnt", "prod_cnt", p.hour_given_product),
        "hour_user_reorder_prob": at("user_hour_rcnt", "user_rcnt", p.hours),
        "week_user_reorder_prob": at("user_week_rcnt", "user_rcnt", p.days),
        "hour_prod_reorder_prob": at("prod_hour_rcnt", "prod_rcnt", p.hours),
        "week_prod_reorder_prob": at("prod_week_rcnt", "prod_rcnt", p.days),
        "hour_prod_user_reorder_prob": at("prod_user_hour_rcnt", "prod_user_rcnt", p.hours),
        "week_prod_user_reorder_prob": at("prod_user_week_rcnt", "prod_user_rcnt", p.days),
    }
    return {name: columns[name] for name in TIME_FEATURES}


def time_features(
    candidates: DataFrame,
    orders: DataFrame,
    history: DataFrame,
    params: FeatureParams = FeatureParams(),
) -> DataFrame:
    """One row per candidate, for the day and hour of its own order.

    Only counts at the target's day and hour are needed, so reorders are matched with the
    user's target first and counted in one pass: there is no user x product x hour table.
    """
    targets = orders.filter(F.col("eval_set") != "prior").select(
        "order_id",
        "user_id",
        F.col("order_dow").alias("target_dow"),
        F.col("order_hour_of_day").alias("target_hour"),
    )
    same_hour = F.col("order_hour_of_day") == F.col("target_hour")
    same_day = F.col("order_dow") == F.col("target_dow")
    reorders = (
        history.filter(F.col("reordered") == 1)
        .select("user_id", "product_id", "order_dow", "order_hour_of_day")
        .join(targets, "user_id")
        .groupBy(*KEYS).agg(
            F.count(F.lit(1)).alias("prod_user_rcnt"),
            F.count_if(same_hour).alias("prod_user_hour_rcnt"),
            F.count_if(same_day).alias("prod_user_week_rcnt"),
        )
    )
    per_order = reorders.groupBy("order_id").agg(
        F.sum("prod_user_rcnt").alias("user_rcnt"),
        F.sum("prod_user_hour_rcnt").alias("user_hour_rcnt"),
        F.sum("prod_user_week_rcnt").alias("user_week_rcnt"),
    )
    cube = materialise(time_cube(history), "cube")
    hours = slot_totals(cube, "order_hour_of_day", "hour_cnt")
    days = slot_totals(cube, "order_dow", "week_cnt")
    rows = (
        candidates.select(*KEYS)
        .join(reorders, KEYS, "left")
        .join(targets.join(per_order, "order_id", "left"), ["order_id", "user_id"])
        .join(materialise(product_profile(cube), "profile"), "product_id", "left")
    )
    rows = with_slot_counts(with_slot_totals(rows, hours, days))
    return rows.select(*KEYS, *[col.alias(name) for name, col in time_columns(params).items()])


def with_slot_totals(rows: DataFrame, hours: DataFrame, days: DataFrame) -> DataFrame:
    """A day has 24 hours and a week 7 days, so Spark broadcasts both tables by their size."""
    return rows.join(
        hours.withColumnRenamed("order_hour_of_day", "target_hour"), "target_hour", "left"
    ).join(days.withColumnRenamed("order_dow", "target_dow"), "target_dow", "left")
