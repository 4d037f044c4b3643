"""Order history out of a star schema (orders, lineitem, part).

A product is a (brand, type) combination, a user is a customer, and a user's last order is
the one to predict. All of it is joins, aggregates and windows over bounded groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encore.functions.columns import flag

# Product types in the order of their index.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
NO_DAY = -(2**31)  # before every day


@dataclass(frozen=True)
class Star:
    """The raw tables; each is opened once, however many operators read it."""

    orders: DataFrame
    lineitem: DataFrame
    part: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Star:
        return cls(*[
            spark.read.parquet(f"{folder}/{name}.parquet")
            for name in ("orders", "lineitem", "part")
        ])


def _brand() -> Column:
    return F.expr("substring(p_brand, 7)").cast("int")


def _type_index() -> Column:
    index = F.create_map(*[F.lit(x) for pair in zip(TYPES, range(len(TYPES))) for x in pair])
    unknown = F.raise_error(
        F.concat(F.lit("unknown part type: "), F.coalesce("p_type", F.lit("null"))))
    return F.coalesce(index[F.col("p_type")], unknown.cast("int"))


def canonical_products(star: Star) -> DataFrame:
    return star.part.select(
        (_brand() * 10 + _type_index()).cast("long").alias("product_id"),
        F.concat_ws(" ", "p_brand", "p_type").alias("product_name"),
        _brand().alias("aisle_id"),
        (_type_index() + 1).cast("int").alias("department_id"),
    ).distinct()


def _raw_lines(star: Star) -> DataFrame:
    """Order lines with their product; lines of one order and product may still repeat."""
    part = star.part.select(
        F.col("p_partkey").alias("l_partkey"),
        (_brand() * 10 + _type_index()).cast("long").alias("product_id"),
    )
    return (
        star.lineitem.join(part, "l_partkey")
        .select(F.col("l_orderkey").alias("order_id"), "product_id", "l_linenumber")
    )


def canonical_orders(star: Star) -> DataFrame:
    """Orders that have lines, numbered per user; the last one is ``train`` or ``test``.

    Numbers and day gaps come from the user's order *days*: a user has at most one row per
    calendar day there, which bounds the per-user window, and ties are numbered inside the
    day. A user with a large part of all orders is thus spread over as many tasks as days.
    """
    kept = (
        star.orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("day"),
        )
        .join(star.lineitem.select(F.col("l_orderkey").alias("order_id")), "order_id", "left_semi")
        .filter("user_id is not null")
        # Nulls first. A key without nulls, so that days and numbers below read the same exchange.
        .withColumn("_day", F.coalesce(F.unix_date("day"), F.lit(NO_DAY)))
        .repartition("user_id", "_day")
    )
    by_day = W.partitionBy("user_id").orderBy("_day")
    days = (
        kept.groupBy("user_id", "_day")
        .agg(F.count("order_id").alias("_n"), F.max("day").alias("_this_day"))
        .select(
            "user_id",
            "_day",
            F.coalesce(
                F.sum("_n").over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
            F.lag("_this_day").over(by_day).alias("_prev_day"),
            # Numbered from the last order of the last day: no second window for the user's total.
            F.when(F.lead("_day").over(by_day).isNull(), F.col("_n")).alias("_last"),
        )
    )
    in_day = F.row_number().over(W.partitionBy("user_id", "_day").orderBy("order_id"))
    numbered = (
        kept.withColumn("_rank", in_day).join(days, ["user_id", "_day"])
        .filter("day is not null")
        .withColumn("_number", F.col("_before") + F.col("_rank"))
    )
    target = F.when(F.col("user_id") % 3 == 0, "test").otherwise("train")
    gap = (
        F.when(F.col("_rank") > 1, F.lit(0))
        .when(F.col("_prev_day").isNotNull(), F.datediff("day", "_prev_day"))
    )
    return numbered.select(
        "order_id",
        "user_id",
        F.when(F.col("_rank") == F.col("_last"), target).otherwise("prior").alias("eval_set"),
        F.col("_number").cast("int").alias("order_number"),
        (F.dayofweek("day") - 1).alias("order_dow"),
        (F.col("order_id") % 24).cast("int").alias("order_hour_of_day"),
        gap.cast("double").alias("days_since_prior_order"),
    )


def all_purchases(star: Star, orders: DataFrame, cart: bool = False) -> DataFrame:
    """One row per order and product, with the columns of ``orders`` and ``reordered``.

    Order numbers are unique within a user. Lines meet their order in a join of two plain shuffles, which
    Spark can split. Sorted along a pair's order numbers, a line that repeats has the number of the line
    before it, and only lines of the pair's first order have the lowest: both come from running windows,
    which keep no rows of the pair, so lines are moved once for the order and once for the pair.
    With ``cart`` the lowest line number stays as ``first_line``.
    """
    lines = _raw_lines(star).withColumnRenamed("l_linenumber", "first_line").join(orders, "order_id")
    lines = lines.filter("user_id is not null and product_id is not null")
    along = [F.col("order_number")]
    if cart:
        along.append(F.asc_nulls_last("first_line"))
    else:
        lines = lines.drop("first_line")
    pair = W.partitionBy("user_id", "product_id").orderBy(*along)
    first = F.min("order_number").over(pair.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = lines.withColumns({"_first": first, "_line_before": F.lag("order_number").over(pair)})
    return (
        marked.filter("_line_before is null or _line_before < order_number")
        .withColumn("reordered", flag(F.col("order_number") > F.col("_first")))
        .select("user_id", "product_id", "order_id", *(["first_line"] if cart else []),
                *[name for name in orders.columns if name not in ("user_id", "order_id")], "reordered")
    )


def prior(purchases: DataFrame) -> DataFrame:
    """History rows (see ``purchase_history``) among all purchases."""
    return purchases.filter(F.col("eval_set") == "prior").drop("eval_set")


def history(star: Star, orders: DataFrame) -> DataFrame:
    """Purchases of prior orders only; lines of other orders are not read into the joins."""
    wanted = orders.filter(F.col("eval_set") == "prior")
    return prior(all_purchases(star, wanted))


def order_products(purchases: DataFrame, eval_set: str) -> DataFrame:
    """Lines of ``prior`` or ``train`` orders; those of ``test`` orders are what is asked for.

    The cart position is a window over one order, which the product range bounds.
    """
    in_order = W.partitionBy("order_id").orderBy("first_line", "product_id")
    return purchases.filter(F.col("eval_set") == eval_set).select(
        "order_id",
        "product_id",
        F.row_number().over(in_order).alias("add_to_cart_order"),
        "reordered",
    )
