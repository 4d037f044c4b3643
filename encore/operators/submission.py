"""From scores to one predicted basket per order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.functions.columns import flag


def ensemble_vote(rows: DataFrame, scores: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """One score column per model, each with its own threshold, voted into ``pred``.

    More than k // 2 + 1 votes are needed: four of five, not a simple majority.
    """
    votes = sum(
        (flag(F.col(name) > t) for name, t in zip(scores, thresholds, strict=True)), F.lit(0)
    )
    return rows.withColumn("votes", votes).withColumn(
        "pred", flag(F.col("votes") > len(scores) // 2 + 1)
    )


def submission(predicted: DataFrame) -> DataFrame:
    """One row per order: predicted products in ascending order, or ``None``.

    Orders without a prediction are groups like the others, so no anti join is needed. The
    list is one order's basket, which is a single string in the output.
    """
    chosen = F.sort_array(F.collect_list(F.when(F.col("pred") == 1, F.col("product_id"))))
    products = F.array_join(F.transform(chosen, lambda p: p.cast("string")), " ")
    return predicted.groupBy("order_id").agg(
        F.when(F.size(chosen) == 0, F.lit("None")).otherwise(products).alias("products")
    )
