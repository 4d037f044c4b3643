"""Prefix sums that do not put one group into one task.

A window over ``PARTITION BY user`` sends a user's rows to a single task, however many
they are. Here each group is cut into chunks: rows are summed inside their chunk, the
chunk totals (one row per chunk) are summed over the chunks before, and the two are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    values: dict[str, Column],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add one running sum per entry of ``values``, within ``keys`` and along ``order``.

    ``chunk`` must be a deterministic integer that never falls along ``order``; any such
    expression gives the same sums, a finer one spreads a large group over more tasks.
    ``totals`` maps a name in ``values`` to a column that gets the sum over the whole group.
    """
    keys, totals = list(keys), totals or {}
    work = df.withColumn("_chunk", chunk).withColumns(
        {f"_v_{name}": value for name, value in values.items()}
    )
    in_chunk = (
        W.partitionBy(*keys, "_chunk").orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    before = (
        W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    whole = W.partitionBy(*keys)
    sums = (
        work.groupBy(*keys, "_chunk")
        .agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
        .select(
            *keys,
            "_chunk",
            *[F.sum(f"_s_{name}").over(before).alias(f"_o_{name}") for name in values],
            *[F.sum(f"_s_{name}").over(whole).alias(out) for name, out in totals.items()],
        )
    )
    if not totals:
        # The first chunk of a group has nothing before it: most groups then drop out here.
        first = F.lit(False)
        for name in values:
            first = first | F.col(f"_o_{name}").isNotNull()
        sums = sums.filter(first)
    return (
        work.withColumns({name: F.sum(f"_v_{name}").over(in_chunk) for name in values})
        .join(sums, [*keys, "_chunk"], "inner" if totals else "left")
        .withColumns(
            {name: F.col(name) + F.coalesce(F.col(f"_o_{name}"), F.lit(0)) for name in values}
        )
        .drop("_chunk", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])
    )
