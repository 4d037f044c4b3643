"""Evaluation of scored candidates: (order_id, user_id, product_id, label, pred_prob)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encore.config import KEYS
from encore.functions.columns import f1, flag, safe_div


def thresholded(scored: DataFrame, threshold: float) -> DataFrame:
    """``pred`` = 1 where the score is strictly above the threshold."""
    return scored.withColumn("pred", flag(F.col("pred_prob") > threshold))


def _outcomes(threshold: float) -> dict[str, Column]:
    above, true = F.col("pred_prob") > threshold, F.col("label") == 1
    return {
        "tp": F.count_if(above & true),
        "predicted": F.count_if(above),
        "actual": F.count_if(true),
    }


def per_user_f1(scored: DataFrame, threshold: float) -> DataFrame:
    """F1 of each user's rows, 0 where undefined."""
    counts = _outcomes(threshold)
    return scored.groupBy("user_id").agg(
        f1(counts["tp"], counts["predicted"], counts["actual"]).alias("f1")
    )


def mean_user_f1(scored: DataFrame, threshold: float) -> DataFrame:
    """Unweighted mean over users, in one row."""
    return per_user_f1(scored, threshold).agg(F.avg("f1").alias("mean_f1"))


def user_debug_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, accuracy and F1 of each user; undefined ones are 0."""
    counts = scored.groupBy("user_id").agg(
        *[col.alias(name) for name, col in _outcomes(threshold).items()],
        F.count(F.lit(1)).alias("rows"),
    )
    tp, predicted, actual = F.col("tp"), F.col("predicted"), F.col("actual")
    right = F.col("rows") - predicted - actual + 2 * tp
    zero = F.lit(0.0)
    return counts.select(
        "user_id",
        F.coalesce(safe_div(tp, predicted), zero).alias("precision"),
        F.coalesce(safe_div(tp, actual), zero).alias("recall"),
        safe_div(right, F.col("rows")).alias("accuracy"),
        f1(tp, predicted, actual).alias("f1"),
    )


def scored_rows(scored: DataFrame, threshold: float) -> DataFrame:
    """The rows of the record-level debug dump."""
    return thresholded(scored, threshold).select(*KEYS, "label", "pred_prob", "pred")


def ranked_blocks(distinct_scores: DataFrame) -> DataFrame:
    """Number blocks of rows from the highest scores down in ``_block``.

    Each block is one range of scores, of about equal size, so that running sums can be taken
    per block and joined over the few blocks: no task sees all scores. Bounds are drawn once
    per exchange; use the result in one branch of a plan only.
    """
    return distinct_scores.repartitionByRange(F.desc("pred_prob")).withColumn(
        "_block", F.spark_partition_id()
    )


def over_blocks() -> tuple:
    """Windows over block summaries: as many rows as there are shuffle partitions, at most."""
    ordered = W.partitionBy(F.lit(0)).orderBy("_block")
    return ordered, ordered.rowsBetween(W.unboundedPreceding, -1)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; NULL if a class is missing."""
    wide = "decimal(19,0)"
    scores = scored.groupBy("pred_prob").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    higher = (
        W.partitionBy("_block").orderBy(F.desc("pred_prob"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    above = F.coalesce(F.sum("pos").over(higher), F.lit(0))
    blocks = (
        ranked_blocks(scores)
        .withColumn("_won2", F.col("neg").cast(wide) * (2 * above + F.col("pos")).cast(wide))
        .groupBy("_block").agg(
            F.sum("_won2").alias("won2"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        )
    )
    _, before = over_blocks()
    pos_before = F.coalesce(F.sum("pos").over(before), F.lit(0))
    return (
        blocks.withColumn(
            "won2", F.col("won2") + F.col("neg").cast(wide) * (2 * pos_before).cast(wide)
        )
        .agg(F.sum("won2").alias("won2"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(
            safe_div(
                F.col("won2"), F.lit(2.0) * F.col("pos").cast("double") * F.col("neg")
            ).alias("auc")
        )
    )


def roc_auc_by(scored: DataFrame, by: Sequence[str], rows: str | None = None) -> DataFrame:
    """``roc_auc`` of every group in one pass: the columns of ``by``, and ``auc``.

    ``rows`` names a column that says how many rows a row stands for.

    Scores are ranked in blocks, ranges of (group, score): a large group spreads over many blocks and
    a block holds many small groups. Each piece of a group counts within its block, pieces are
    added along the group.
    """
    by, wide = list(by), "decimal(19,0)"
    weight = F.lit(1).cast("long") if rows is None else F.col(rows)
    scores = scored.groupBy(*by, "pred_prob").agg(*[
        F.sum(F.when(F.col("label") == value, weight).otherwise(0)).alias(name)
        for name, value in (("pos", 1), ("neg", 0))])
    pieces = scores.repartitionByRange(*by, F.desc("pred_prob")).withColumn(
        "_block", F.spark_partition_id())
    higher = (
        W.partitionBy(*by, "_block").orderBy(F.desc("pred_prob")).rowsBetween(W.unboundedPreceding, -1)
    )
    above = F.coalesce(F.sum("pos").over(higher), F.lit(0))
    return auc_of_blocks(pieces.withColumn(
        "_won2", F.col("neg").cast(wide) * (2 * above + F.col("pos")).cast(wide)
    ).groupBy(*by, "_block").agg(
        F.sum("_won2").alias("won2"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), by)


def auc_of_blocks(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The columns of ``by``, and ``auc``, of groups cut into ranges of scores, numbered in ``_block`` from the top.

    A block has its positives, negatives and twice the pairs that it orders rightly (``won2``; a tie is half a pair).
    """
    by, wide = list(by), "decimal(19,0)"
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    pos_before = F.coalesce(F.sum("pos").over(before), F.lit(0))  # a group's pieces: at most the blocks
    return blocks.withColumn(
        "won2", F.col("won2") + F.col("neg").cast(wide) * (2 * pos_before).cast(wide)
    ).groupBy(*by).agg(
        safe_div(F.sum("won2"), F.lit(2.0) * F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def worst_user(user_metrics: DataFrame) -> DataFrame:
    """The user with the lowest F1 (then the lowest id), as one row."""
    return user_metrics.agg(F.min(F.struct("f1", "user_id")).alias("w")).select("w.user_id")


def case_rows(rows: DataFrame, case: DataFrame) -> DataFrame:
    """Rows of the looked-up keys, as many as the analyst asks for."""
    return rows.join(case, case.columns, "left_semi")
