"""Search for the decision threshold that gives the best mean per-user F1.

The threshold is tuned on the rows it is then scored on, so the F1 it reports is optimistic.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encore.functions.columns import f1, flag
from encore.functions.prefix import running_sums
from encore.operators.scoring import over_blocks, ranked_blocks
from encore.session import materialise

# Parts per unit of F1 in exact integer arithmetic, and score bands a user's rows are cut in.
UNITS = 10**12
BANDS = 256
# Thresholds of a pass of the bracketed search, and passes at most.
POINTS, MOST_PASSES = 41, 12


def grid(low: float, high: float, steps: int) -> list[float]:
    """steps + 1 evenly spaced thresholds."""
    return [round(low + (high - low) * i / steps, 12) for i in range(steps + 1)]


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Mean per-user F1 at each threshold, in one pass.

    Thresholds become columns of one aggregate per user and one over users. Rows are not
    multiplied by the number of thresholds, neither before a shuffle nor after.
    """
    actual = F.count_if(F.col("label") == 1).alias("actual")
    counts = [actual]
    for i, t in enumerate(thresholds):
        above = F.col("pred_prob") > t
        counts += [
            F.count_if(above).alias(f"n{i}"),
            F.count_if(above & (F.col("label") == 1)).alias(f"tp{i}"),
        ]
    users = scored.groupBy("user_id").agg(*counts)
    means = users.agg(*[
        F.avg(f1(F.col(f"tp{i}"), F.col(f"n{i}"), F.col("actual"))).alias(f"m{i}")
        for i in range(len(thresholds))
    ])
    pairs = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"m{i}").alias("mean_f1"))
        for i, t in enumerate(thresholds)
    ]
    return means.select(F.inline(F.array(*pairs)))


def best_threshold(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The best of the given thresholds, the lowest of equals (to nine decimals)."""
    mean, low = F.round("mean_f1", 9).alias("mean_f1"), (-F.col("threshold")).alias("low")
    best = F.max(F.struct(mean, low)).alias("best")
    return threshold_sweep(scored, thresholds).agg(best).select(
        (-F.col("best.low")).alias("threshold"), F.col("best.mean_f1").alias("mean_f1")
    )


def score_steps(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per group, user and score: all that thresholds depend on."""
    return scored.groupBy(*by, "user_id", "pred_prob").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count(F.lit(1)).alias("rows"))


def _sections(low: float, high: float, points: int) -> list[float]:
    return [round(low + (high - low) * i / (points - 1), 12) for i in range(points)]


def threshold_search(
    scored: DataFrame,
    low: float,
    high: float,
    tolerance: float,
    by: Sequence[str] = (),
    points: int = POINTS,
) -> DataFrame:
    """Search for each group's threshold from a bracket: ``by``, threshold, mean_f1, passes.

    Each pass takes the mean F1 at evenly spaced thresholds between a group's bounds, all groups
    and thresholds as columns of one aggregate, and narrows the bounds to the neighbours of the best
    (the lowest of equals, to nine decimals), until these are ``tolerance`` apart. The bracket is a start
    and not a bound: where its first or last threshold is the best, the search goes on to 0 or 1 on
    that side. Mean F1 has many local maxima, so this is a good threshold and not always the best one
    (``best_threshold_exact``).

    Rows are reduced to (group, user, score) once; that table is stored and read by each pass. One row
    per group comes to the driver.
    """
    by = list(by)
    steps = materialise(score_steps(scored, by), "score-steps")
    groups = [tuple(row) for row in steps.select(*by).distinct().collect()] if by else [()]
    bounds = {group: (low, high) for group in groups}
    best: dict[tuple, tuple[float, float, int]] = {}
    widened: set[tuple] = set()
    for number in range(1, MOST_PASSES + 1):
        if not bounds:
            break
        tried = {group: _sections(*edges, points) for group, edges in bounds.items()}
        for group, means in _means_at(steps, by, tried, points).items():
            ranked = [round(mean, 9) for mean in means]
            at = ranked.index(max(ranked))
            cuts = tried[group]
            best[group] = (cuts[at], ranked[at], number)
            left, right = cuts[max(at - 1, 0)], cuts[min(at + 1, points - 1)]
            if group not in widened and number == 1 and at in (0, points - 1):
                left, right = (0.0, right) if at == 0 else (left, 1.0)
                widened.add(group)
            elif cuts[1] - cuts[0] <= tolerance * (1 + 1e-6):
                del bounds[group]
                continue
            bounds[group] = (left, right)
        for group in [g for g in bounds if g not in best]:
            del bounds[group]  # no rows
    schema = "".join(f"{steps.schema[name].simpleString().replace(':', ' ', 1)}, " for name in by)
    return scored.sparkSession.createDataFrame(
        [(*group, *found) for group, found in best.items()],
        schema + "threshold double, mean_f1 double, passes int")


def _means_at(
    steps: DataFrame, by: list[str], tried: dict[tuple, list[float]], points: int,
) -> dict[tuple, list[float]]:
    """Mean F1 over users of each group at each of its thresholds."""
    if by:  # each group's thresholds, by its place in the list
        order = {group: i for i, group in enumerate(tried)}
        place = F.lit(None).cast("int")
        for group, i in order.items():
            same = [F.col(name).eqNullSafe(F.lit(value)) for name, value in zip(by, group, strict=True)]
            place = F.when(reduce(and_, same), i).otherwise(place)
        steps = steps.withColumn("_group", place).filter("_group is not null")
        table = F.from_json(F.lit(json.dumps(list(tried.values()))), "array<array<double>>")
        cuts = F.element_at(table, F.col("_group") + 1)
        at = [cuts[i] for i in range(points)]
    elif () in tried:
        at = [F.lit(t) for t in tried[()]]
    counts = [F.sum("pos").alias("actual")]
    for i, t in enumerate(at):
        above = F.col("pred_prob") > t
        counts += [F.sum(F.when(above, F.col("rows")).otherwise(0)).alias(f"n{i}"),
                   F.sum(F.when(above, F.col("pos")).otherwise(0)).alias(f"tp{i}")]
    means = [F.avg(f1(F.col(f"tp{i}"), F.col(f"n{i}"), F.col("actual"))).alias(f"m{i}") for i in range(points)]
    found = steps.groupBy(*by, "user_id").agg(*counts).groupBy(*by).agg(*means).collect()
    return {tuple(row)[:len(by)]: list(row)[len(by):] for row in found if row[len(by)] is not None}


def best_threshold_exact(scored: DataFrame) -> DataFrame:
    """The best threshold of all: (threshold, mean_f1), the highest of equals.

    A user's F1 only changes at the user's own scores. Going down the scores, each change is
    taken as an exact integer; changes are added per score, then along all scores, and the
    maximum of the running sum is the best mean. As a prediction is *strictly* above the
    threshold, the threshold is the next lower score (or 1 below the lowest one).
    """
    per_score = materialise(score_steps(scored), "score-steps")  # read by both branches below
    running = running_sums(
        per_score,
        keys=["user_id"],
        order=[F.desc("pred_prob")],
        chunk=F.floor(-F.col("pred_prob") * BANDS),
        values={"tp": F.col("pos"), "predicted": F.col("rows")},
        totals={"tp": "actual"},
    )
    tp, predicted, actual = F.col("tp"), F.col("predicted"), F.col("actual")

    def units(t, n):
        return F.floor(f1(t, n, actual) * UNITS).cast("decimal(18,0)")

    gain = units(tp, predicted) - units(tp - F.col("pos"), predicted - F.col("rows"))
    per_score = running.groupBy("pred_prob").agg(
        F.sum(gain).alias("gain"), F.sum(flag(predicted == F.col("rows"))).alias("users")
    )
    down = W.partitionBy("_block").orderBy(F.desc("pred_prob"))
    blocks = (
        ranked_blocks(per_score)
        .withColumns({
            "_sum": F.sum("gain").over(down.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "_next": F.lead("pred_prob").over(down),
        })
        .groupBy("_block").agg(
            F.sum("gain").alias("gain"),
            F.sum("users").alias("users"),
            F.max("pred_prob").alias("top"),
            F.max(F.struct("_sum", "pred_prob", "_next")).alias("best"),
        )
    )
    ordered, before = over_blocks()
    total = F.coalesce(F.sum("gain").over(before), F.lit(0)) + F.col("best._sum")
    following = F.coalesce(
        F.col("best._next"), F.lead("top").over(ordered), F.col("best.pred_prob") - 1
    )
    return (
        blocks.select(
            "users",
            F.struct(
                total.alias("total"), F.col("best.pred_prob").alias("score"),
                following.alias("following"),
            ).alias("best"),
        )
        .agg(F.max("best").alias("best"), F.sum("users").alias("users"))
        .select(
            F.col("best.following").alias("threshold"),
            (F.col("best.total").cast("double") / F.lit(float(UNITS)) / F.col("users"))
            .alias("mean_f1"),
        )
    )
