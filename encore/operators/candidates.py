"""Candidates: every product a user has bought before, for the user's next order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.config import FOLDS, KEYS
from encore.functions.columns import flag, fold_of


def user_order_products(prior_lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Who bought what in which order."""
    return orders.select("order_id", "user_id").join(
        prior_lines.select("order_id", "product_id"), "order_id"
    ).select("order_id", "user_id", "product_id")


def user_products(bought: DataFrame) -> DataFrame:
    """Distinct (user, product) pairs."""
    return bought.select("user_id", "product_id").distinct()


def candidates(orders: DataFrame, pairs: DataFrame, eval_set: str) -> DataFrame:
    """The user's earlier products against the user's ``train`` or ``test`` order."""
    target = orders.filter(F.col("eval_set") == eval_set).select("order_id", "user_id")
    return target.join(pairs, "user_id").select(*KEYS)


def labelled(train_candidates: DataFrame, truth_lines: DataFrame) -> DataFrame:
    """label = 1 where the product is a reorder in the target order, else 0."""
    truth = truth_lines.select("order_id", "product_id", "reordered")
    return train_candidates.join(truth, ["order_id", "product_id"], "left").select(
        *KEYS, flag(F.col("reordered") == 1).alias("label")
    )


def with_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Fold of the row's user in ``seed``: a hash, so no join with a table of random draws."""
    return rows.withColumn("seed", fold_of(F.col("user_id"), folds))


def fold_assignment(orders: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per user that has a ``train`` order."""
    users = orders.filter(F.col("eval_set") == "train").select("user_id").distinct()
    return with_folds(users, folds)
