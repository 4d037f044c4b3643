"""Column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encore.config import FOLDS


def safe_div(n: Column, d: Column) -> Column:
    """n / d as a double; NULL where d is 0 or either side is NULL."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def smoothed(n: Column, d: Column, k: int) -> Column:
    """Add-one share over k values: (n + 1) / (d + k), missing counts being 0."""
    return (count_or_zero(n) + 1).cast("double") / (count_or_zero(d) + k).cast("double")


def count_or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is NULL)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def repeat_ratio(reordered: Column) -> Column:
    """Aggregate: all rows per rows that are not a reorder."""
    return safe_div(F.count(F.lit(1)), F.count_if(reordered == 0))


def fold_of(user_id: Column, folds: int = FOLDS) -> Column:
    """Fold 0 .. folds-1 of a user: a multiplicative hash in plain 64-bit arithmetic.

    A pure function of the key, so a recomputed task always gives a user the same fold.
    """
    spread = F.pmod(user_id % F.lit(2**31) * F.lit(2654435761), F.lit(2**32))
    return F.pmod(F.floor(spread / F.lit(65536)), F.lit(folds)).cast("int")


def f1(tp: Column, predicted: Column, actual: Column) -> Column:
    """2TP / (predicted + actual), 0 where nothing is predicted and nothing is true."""
    return F.coalesce(safe_div(2 * tp, predicted + actual), F.lit(0.0))
