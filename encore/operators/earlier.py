"""The earlier feature set. Its names partly mean other things than those of the main set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encore.config import KEYS
from encore.functions.columns import repeat_ratio, safe_div
from encore.operators.timeofweek import product_profile, time_cube
from encore.session import materialise

DAYS = 7
HOURS = 24


def pair_counts(history: DataFrame) -> DataFrame:
    """The pair grain that product and pair statistics of this set roll up from."""
    again = F.col("reordered") == 1
    return history.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(again).alias("again"),
        F.count_if(F.col("reordered") == 0).alias("new"),
        F.sum(F.when(again, F.col("days_since_prior_order"))).alias("gap_days"),
        F.count(F.when(again, F.col("days_since_prior_order"))).alias("gaps"),
        F.min("order_number").alias("first"),
        F.max("order_number").alias("last"),
    )


def order_counts(history: DataFrame) -> DataFrame:
    """The order grain that basket sizes and time shares roll up from."""
    return history.groupBy(
        "user_id", "order_id", "order_number", "order_dow", "order_hour_of_day"
    ).agg(F.count(F.lit(1)).alias("lines"), F.sum("reordered").alias("again"))


def product_reorder_stats(history: DataFrame) -> DataFrame:
    """Purchases and reorders of each product."""
    return _reorder_stats(pair_counts(history))


def _reorder_stats(pairs: DataFrame) -> DataFrame:
    """The share of second purchases is that of pairs with two or more: no numbering needed."""
    return pairs.groupBy("product_id").agg(
        safe_div(F.count_if(F.col("n") >= 2), F.count(F.lit(1)))
        .alias("prod_norder_second_order_rate"),
        safe_div(F.sum("n"), F.sum("new")).alias("prod_norder_reorder_rate"),
        F.sum("n").alias("prod_norder"),
        F.sum("again").alias("prod_nreorder"),
    )


def product_reorder_rate(history: DataFrame) -> DataFrame:
    """Lines per first-time line, straight from the lines."""
    return history.groupBy("product_id").agg(
        repeat_ratio(F.col("reordered")).alias("prod_norder_reorder_rate")
    )


def product_user_reorder(history: DataFrame) -> DataFrame:
    """Users and reordering users; products that nobody reordered have no row."""
    return _user_reorder(pair_counts(history))


def _user_reorder(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("product_id").agg(
            F.count(F.lit(1)).alias("prod_nuser"),
            F.count_if(F.col("again") > 0).alias("prod_nuser_reorder"),
        )
        .filter(F.col("prod_nuser_reorder") > 0)
        .withColumn(
            "prod_nuser_reorder_rate", safe_div(F.col("prod_nuser_reorder"), F.col("prod_nuser"))
        )
    )


def product_reorder_gap(history: DataFrame) -> DataFrame:
    """Mean days_since_prior_order of reordered lines."""
    return _reorder_gap(pair_counts(history))


def _reorder_gap(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("again") > 0).groupBy("product_id").agg(
        safe_div(F.sum("gap_days"), F.sum("gaps")).alias("prod_days_interval_avg")
    )


def _slot_share(history: DataFrame, slot: str, of_product: str, of_slot: str) -> DataFrame:
    cells = history.groupBy("product_id", slot).agg(F.count(F.lit(1)).alias("_n"))
    slots = cells.groupBy(slot).agg(F.sum("_n").alias("_slot"))
    whole = F.sum("_n").over(W.partitionBy("product_id"))
    # A product has at most 7 or 24 cells, a slot as many as there are products: the former
    # is a window, the latter an aggregate of 7 or 24 rows, which Spark broadcasts by its size.
    return (
        cells.withColumn("_product", whole).join(slots, slot)
        .select(
            "product_id",
            slot,
            safe_div(F.col("_n"), F.col("_product")).alias(of_product),
            safe_div(F.col("_n"), F.col("_slot")).alias(of_slot),
        )
    )


def product_dow_share(history: DataFrame) -> DataFrame:
    """Share of the day among the product's lines, and of the product among the day's."""
    return _slot_share(history, "order_dow", "prod_week_prob", "week_prod_prob")


def product_hour_share(history: DataFrame) -> DataFrame:
    return _slot_share(history, "order_hour_of_day", "prod_hour_prob", "hour_prod_prob")


def _slot_smoothed(history: DataFrame, slot: str, size: int, name: str) -> DataFrame:
    """Add-one share over the full grid: each product gives all its slots, bought in or not."""
    cells = history.groupBy("product_id", slot).agg(F.count(F.lit(1)).alias("_n"))
    per_product = cells.groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct(slot, "_n"))).alias("_cells"),
        F.sum(F.when(F.col(slot).between(0, size - 1), F.col("_n"))).alias("_total"),
    )
    count = F.coalesce(F.col("_cells")[F.col(slot)], F.lit(0))
    total = F.coalesce(F.col("_total"), F.lit(0)) + size
    return (
        per_product.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        .select("product_id", slot, safe_div(count + 1, total).alias(name))
    )


def product_dow_smoothed(history: DataFrame) -> DataFrame:
    return _slot_smoothed(history, "order_dow", DAYS, "week_prob")


def product_hour_smoothed(history: DataFrame) -> DataFrame:
    return _slot_smoothed(history, "order_hour_of_day", HOURS, "hour_prob")


def user_product_order_stats(history: DataFrame) -> DataFrame:
    """Purchase rates of a pair over all, recent and later orders of the user."""
    return _order_stats(pair_counts(history))


def _order_stats(pairs: DataFrame) -> DataFrame:
    users = pairs.groupBy("user_id").agg(F.max("last").alias("orders"))
    return pairs.join(users, "user_id").select(
        "user_id", "product_id", *[c.alias(name) for name, c in _pair_columns().items()])


def _pair_columns() -> dict[str, Column]:
    """Over the pair's counts and the number of its user's orders."""
    c = F.col
    return {
        "user_prod_norder": c("n"),
        "user_prod_order_rate": safe_div(c("n"), c("orders")),
        "user_prod_last_order_vacancy": c("orders") - c("last") + 1,
        "user_prod_order_freq": safe_div(c("n"), c("last") - c("first") + 1),
        "up_order_rate_since_first_order": safe_div(c("n"), c("orders") - c("first") + 1),
    }


def user_basket_stats(history: DataFrame) -> DataFrame:
    """Pooled reorder share without first orders, and basket sizes.

    Users whose only order is their first have no reorder share and no row.
    """
    return _basket_stats(order_counts(history), pair_counts(history))


def _basket_stats(per_order: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct orders and distinct products are rows of their own grains.

    That spares the row expansion of two distinct counts in one aggregate.
    """
    later = F.col("order_number") != 1
    users = per_order.groupBy("user_id").agg(
        safe_div(F.sum(F.when(later, F.col("again"))), F.sum(F.when(later, F.col("lines"))))
        .alias("user_reorder_ratio"),
        F.sum("lines").alias("user_total_items"),
        safe_div(F.sum("lines"), F.count(F.lit(1))).alias("user_avg_items"),
    )
    distinct = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_distinct_items"))
    return users.filter(F.col("user_reorder_ratio").isNotNull()).join(distinct, "user_id").select(
        "user_id", "user_reorder_ratio", "user_distinct_items", "user_total_items",
        "user_avg_items",
    )


def user_interval_avg(orders: DataFrame) -> DataFrame:
    """Mean day gap over all orders, the one to predict included."""
    return (
        orders.filter(F.col("days_since_prior_order").isNotNull()).groupBy("user_id")
        .agg(F.avg("days_since_prior_order").alias("user_interval_avg"))
    )


def _user_slot_share(per_order: DataFrame, slot: str, name: str) -> DataFrame:
    cells = per_order.groupBy("user_id", slot).agg(F.count(F.lit(1)).alias("_n"))
    # At most 7 or 24 cells per user.
    whole = F.sum("_n").over(W.partitionBy("user_id"))
    return cells.select("user_id", slot, safe_div(F.col("_n"), whole).alias(name))


def user_dow_share(history: DataFrame) -> DataFrame:
    """Share of each day among the user's prior orders."""
    return _user_slot_share(order_counts(history), "order_dow", "user_week_prob")


def user_hour_share(history: DataFrame) -> DataFrame:
    return _user_slot_share(order_counts(history), "order_hour_of_day", "user_hour_prob")


def legacy_matrix(candidates: DataFrame, orders: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates with the earlier features; shares that are missing stay NULL.

    Candidates whose product was never reordered drop out. All product features and counts by
    slot are in one stored table, all user features at the target's slot in another; candidates
    are joined with these two and with their pair. The tables are stored so that their joins can
    be split where one user or product has very many candidates.
    """
    pairs = materialise(pair_counts(history), "pair-counts")
    product = materialise(_legacy_products(pairs, history), "legacy-products")
    user = materialise(_legacy_users(pairs, orders, history), "legacy-users")
    c = F.col
    labels = [name for name in candidates.columns if name not in KEYS]
    rows = (
        candidates.join(pairs, ["user_id", "product_id"])
        .join(user, ["order_id", "user_id"])
        .join(product, "product_id")
    )
    return rows.withColumns({
        **_pair_columns(),
        "week_prob": _smoothed_at("by_dow", "order_dow", "day_lines", DAYS),
        "hour_prob": _smoothed_at("by_hour", "order_hour_of_day", "hour_lines", HOURS),
        "user_days_since_prior_ratio": safe_div(c("days_since_prior_order"), c("user_interval_avg")),
    }).select(*KEYS, *labels, *LEGACY_FEATURES)


def _legacy_products(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Everything of the products that were reordered, with their lines by day and by hour."""
    users, reorderers = F.count(F.lit(1)), F.count_if(F.col("again") > 0)
    stats = pairs.groupBy("product_id").agg(
        safe_div(F.count_if(F.col("n") >= 2), users).alias("prod_norder_second_order_rate"),
        safe_div(F.sum("n"), F.sum("new")).alias("prod_norder_reorder_rate"),
        F.sum("n").alias("prod_norder"),
        F.sum("again").alias("prod_nreorder"),
        safe_div(F.sum("gap_days"), F.sum("gaps")).alias("prod_days_interval_avg"),
        users.alias("prod_nuser"),
        reorderers.alias("prod_nuser_reorder"),
        safe_div(reorderers, users).alias("prod_nuser_reorder_rate"),
    ).filter(F.col("prod_nuser_reorder") > 0)
    # Added up here, once per product: a candidate only looks its slot up.
    profile = product_profile(time_cube(history)).select(
        "product_id", "by_dow", "by_hour", _lines_within("by_dow", DAYS).alias("day_lines"),
        _lines_within("by_hour", HOURS).alias("hour_lines"))
    return stats.join(profile, "product_id")


def _lines_within(slots: str, size: int) -> Column:
    """The product's lines in valid slots."""
    valid = F.filter(F.map_entries(slots), lambda e: e["key"].between(0, size - 1))
    return F.aggregate(valid, F.lit(0).cast("long"), lambda so_far, e: so_far + e["value"]["cnt"])


def _smoothed_at(slots: str, slot: str, total: str, size: int) -> Column:
    """Add-one share of the target's slot among the product's lines in valid slots."""
    own = F.coalesce(F.col(slots)[F.col(slot)]["cnt"], F.lit(0))
    return F.when(F.col(slot).between(0, size - 1), safe_div(own + 1, F.col(total) + size))


def _legacy_users(pairs: DataFrame, orders: DataFrame, history: DataFrame) -> DataFrame:
    """Target orders with all features of their user, shares being those of the target's slot."""
    c = F.col
    context = orders.filter(c("eval_set") != "prior").select(
        c("order_id").alias("target_id"), "user_id", c("order_dow").alias("target_dow"),
        c("order_hour_of_day").alias("target_hour"),
        c("days_since_prior_order").alias("target_gap"),
    )
    later = c("order_number") != 1
    same_day, same_hour = c("order_dow") == c("target_dow"), c("order_hour_of_day") == c("target_hour")
    number = F.count(F.lit(1))

    def share(same: Column) -> Column:
        return F.when(F.count_if(same) > 0, safe_div(F.count_if(same), number))

    baskets = order_counts(history).join(context, "user_id").groupBy(
        "user_id", "target_id", "target_dow", "target_hour", "target_gap"
    ).agg(
        safe_div(F.sum(F.when(later, c("again"))), F.sum(F.when(later, c("lines"))))
        .alias("user_reorder_ratio"),
        F.sum("lines").alias("user_total_items"),
        safe_div(F.sum("lines"), number).alias("user_avg_items"),
        share(same_day).alias("user_week_prob"),
        share(same_hour).alias("user_hour_prob"),
    ).filter(c("user_reorder_ratio").isNotNull())
    distinct = pairs.groupBy("user_id").agg(
        number.alias("user_distinct_items"), F.max("last").alias("orders"))
    return baskets.join(distinct, "user_id").join(user_interval_avg(orders), "user_id").select(
        "user_id", c("target_id").alias("order_id"), c("target_dow").alias("order_dow"),
        c("target_hour").alias("order_hour_of_day"), c("target_gap").alias("days_since_prior_order"),
        "user_reorder_ratio", "user_distinct_items", "user_total_items", "user_avg_items",
        "user_interval_avg", "user_week_prob", "user_hour_prob", "orders",
    )


# The columns of the earlier matrix.
LEGACY_FEATURES = [
    "prod_norder_second_order_rate", "prod_norder_reorder_rate", "prod_norder", "prod_nreorder",
    "prod_days_interval_avg", "prod_nuser", "prod_nuser_reorder", "prod_nuser_reorder_rate",
    "user_prod_norder", "user_prod_order_rate", "user_prod_last_order_vacancy",
    "user_prod_order_freq", "up_order_rate_since_first_order", "user_reorder_ratio",
    "user_distinct_items", "user_total_items", "user_avg_items", "user_interval_avg",
    "order_dow", "order_hour_of_day", "days_since_prior_order", "week_prob", "hour_prob",
    "user_week_prob", "user_hour_prob", "user_days_since_prior_ratio",
]
