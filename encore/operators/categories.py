"""How a user's and a product's reorders fall on aisles and departments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encore.config import ID_FEATURES, KEYS, FeatureParams
from encore.functions.columns import count_or_zero, safe_div, smoothed
from encore.session import materialise


def with_product_detail(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Aisle and department of each row's product."""
    return rows.join(products.select("product_id", "aisle_id", "department_id"), "product_id")


def reordered_pairs(history: DataFrame, products: DataFrame) -> DataFrame:
    """Reorders per user and product, with the product's categories; stored for several readers."""
    pairs = (
        history.filter(F.col("reordered") == 1)
        .groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("rcnt"))
    )
    return materialise(with_product_detail(pairs, products), "reordered-pairs")


def category_reorders(history: DataFrame, products: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Reordered lines per key that may include aisle or department.

    Lines are first added up per user and product (or product only), then joined with the
    product table: the join sees pairs or products, not lines.
    """
    grain = ["user_id", "product_id"] if "user_id" in keys else ["product_id"]
    reorders = (
        history.filter(F.col("reordered") == 1).groupBy(*grain).agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        with_product_detail(reorders, products).groupBy(*keys).agg(F.sum("_n").alias(name))
    )


def product_category_level(per_product: DataFrame, products: DataFrame) -> DataFrame:
    """All products with their reorders (``rcnt``) and those of their aisle and department."""
    detail = (
        products.select("product_id", "aisle_id", "department_id")
        .join(per_product.select("product_id", "rcnt"), "product_id", "left")
        .withColumn("rcnt", count_or_zero(F.col("rcnt")))
    )
    aisles = detail.groupBy("aisle_id").agg(F.sum("rcnt").alias("aisle_cnt"))
    departments = detail.groupBy("department_id").agg(F.sum("rcnt").alias("dep_cnt"))
    return (
        detail.join(aisles, "aisle_id").join(departments, "department_id")
        .select(
            "product_id",
            "aisle_id",
            "department_id",
            F.col("rcnt").alias("prod_aisle_rcnt"),
            F.col("rcnt").alias("prod_dep_rcnt"),
            "aisle_cnt",
            "dep_cnt",
        )
    )


def user_category_level(pairs: DataFrame) -> DataFrame:
    """Reorders of each user by aisle and by department, per (user, aisle, department) bought.

    ``pairs`` holds n_reordered, aisle_id and department_id. After the aggregate a user has at
    most one row per category, whatever the number of purchases: that bounds the windows. They
    share one exchange on user_id.
    """
    by_category = (
        pairs.groupBy("user_id", "aisle_id", "department_id")
        .agg(F.sum("n_reordered").alias("_n"))
        .repartition("user_id")
    )
    return by_category.select(
        "user_id",
        "aisle_id",
        "department_id",
        F.sum("_n").over(W.partitionBy("user_id", "aisle_id")).alias("user_aisle_rcnt"),
        F.sum("_n").over(W.partitionBy("user_id", "department_id")).alias("user_dep_rcnt"),
    )


def id_columns(p: FeatureParams) -> dict[str, Column]:
    c = F.col
    columns = {
        "aisle_id": c("aisle_id"),
        "department_id": c("department_id"),
        "aisle_user_reorder_prob": smoothed(c("user_aisle_rcnt"), c("user_rcnt"), p.aisles),
        "dep_user_reorder_prob": smoothed(c("user_dep_rcnt"), c("user_rcnt"), p.departments),
        "prod_aisle_reorder_prob": safe_div(c("prod_aisle_rcnt"), c("aisle_cnt")),
        "prod_dep_reorder_prob": safe_div(c("prod_dep_rcnt"), c("dep_cnt")),
    }
    return {name: columns[name] for name in ID_FEATURES}


def id_features(
    candidates: DataFrame,
    products: DataFrame,
    history: DataFrame,
    params: FeatureParams = FeatureParams(),
) -> DataFrame:
    """One row per candidate."""
    reorders = reordered_pairs(history, products)
    by_aisle = reorders.groupBy("user_id", "aisle_id").agg(F.sum("rcnt").alias("user_aisle_rcnt"))
    by_department = reorders.groupBy("user_id", "department_id").agg(
        F.sum("rcnt").alias("user_dep_rcnt")
    )
    by_user = reorders.groupBy("user_id").agg(F.sum("rcnt").alias("user_rcnt"))
    per_product = reorders.groupBy("product_id").agg(F.sum("rcnt").alias("rcnt"))
    rows = (
        candidates.select(*KEYS)
        .join(product_category_level(per_product, products), "product_id")
        .join(by_aisle, ["user_id", "aisle_id"], "left")
        .join(by_department, ["user_id", "department_id"], "left")
        .join(by_user, "user_id", "left")
    )
    return rows.select(*KEYS, *[col.alias(name) for name, col in id_columns(params).items()])


def user_affinity(history: DataFrame, products: DataFrame) -> DataFrame:
    """Unsmoothed shares of a user's reorders, every aisle against every department of the user.

    The two sides meet on user_id alone, so a user's aisles cross with the user's departments,
    which is what is asked for; the size per user is bounded by aisles x departments.
    """
    reorders = reordered_pairs(history, products)
    total = reorders.groupBy("user_id").agg(F.sum("rcnt").alias("_total"))
    aisles = reorders.groupBy("user_id", "aisle_id").agg(F.sum("rcnt").alias("_aisle"))
    departments = reorders.groupBy("user_id", "department_id").agg(F.sum("rcnt").alias("_dep"))
    return (
        total.join(aisles, "user_id").join(departments, "user_id")
        .select(
            "user_id",
            "aisle_id",
            "department_id",
            safe_div(F.col("_aisle"), F.col("_total")).alias("aisle_user_reorder_prob"),
            safe_div(F.col("_dep"), F.col("_total")).alias("department_user_reorder_prob"),
        )
    )
