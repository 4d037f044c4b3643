"""The feature matrix: every candidate with all features, built along few exchanges.

The blocks could be computed one by one and joined on (order_id, user_id, product_id); that
shuffles the candidates once per block. Here they meet at the grain they belong to:

1. Each order learns the day and hour of its user's target order (order grain, before lines
   are joined), so that all user and pair counts at the target's slot become conditional sums.
2. History is aggregated once to pairs. Labels ride along as extra rows of the same aggregate.
3. Candidates are joined with user x category counts while both are narrow, then with user features
   and with one table of product features and counts by hour and day.

History, pairs and the product table have several consumers that need different columns, so
each is written once (see ``materialise``) and serves the training and the test matrix. Their
sizes are then known to Spark, which broadcasts the product table where it is small and
shuffles where it is not.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.config import (
    ALL_FEATURES,
    FOLDS,
    KEYS,
    PRODUCT_FEATURES,
    USER_FEATURES,
    FeatureParams,
)
from encore.functions.columns import flag
from encore.operators.candidates import with_folds
from encore.operators.categories import (
    id_columns,
    product_category_level,
    user_category_level,
)
from encore.operators.history import order_interval_accu, purchase_history
from encore.operators.pairs import pair_aggregates, user_product_columns, with_gaps
from encore.operators.products import product_columns, product_level
from encore.operators.targets import target_columns, target_orders
from encore.operators.timeofweek import (
    product_profile,
    slot_totals,
    time_columns,
    time_cube,
    with_slot_counts,
    with_slot_totals,
)
from encore.operators.users import order_grain, user_columns, user_level
from encore.session import materialise


def single_targets(orders: DataFrame) -> DataFrame:
    """Target orders, one per user; a user with two of them is an error in the input."""
    targets = target_orders(orders)
    rest = [name for name in targets.columns if name not in ("user_id", "eval_set")]
    # Fixed-width buffers only, so that this stays a hash aggregate.
    checked = targets.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("eval_set") == "train").alias("_train"),
        *[F.first(name).alias(name) for name in rest],
    )
    return checked.filter(
        F.when(F.col("_n") == 1, F.lit(True))
        .otherwise(F.raise_error(F.lit("more than one target order of a user")))
    ).select(
        "user_id", *rest,
        F.when(F.col("_train") == 1, "train").otherwise("test").alias("eval_set"),
    )


def toward_target(orders: DataFrame, targets: DataFrame) -> DataFrame:
    """Orders with the slot and set of their user's target; orders of users without one stay."""
    test = flag(F.col("eval_set") == "test").alias(TEST)
    return orders.join(
        targets.select("user_id", "target_dow", "target_hour", test), "user_id", "left"
    )


def matrix_pairs(history: DataFrame, targets: DataFrame, truth_lines: DataFrame | None) -> DataFrame:
    """Pair grain with reorder counts at the target's slot and, if there is truth, the label."""
    rows = history.select(
        "user_id", "product_id", "order_number", "interval_accu", "reordered", TEST,
        flag((F.col("reordered") == 1) & (F.col("order_hour_of_day") == F.col("target_hour")))
        .alias("_hour"),
        flag((F.col("reordered") == 1) & (F.col("order_dow") == F.col("target_dow")))
        .alias("_week"),
    )
    extra = [
        F.sum("_hour").alias("prod_user_hour_rcnt"),
        F.sum("_week").alias("prod_user_week_rcnt"),
        F.max(TEST).alias(TEST),
    ]
    if truth_lines is not None:
        truth = (
            truth_lines.filter(F.col("reordered") == 1).select("order_id", "product_id")
            .join(targets.select("order_id", "user_id"), "order_id")
            .select("user_id", "product_id", F.lit(1).alias("_label"))
        )
        rows = rows.unionByName(truth, allowMissingColumns=True)
        extra.append(flag(F.count("_label") > 0).alias("label"))
    pairs = rows.groupBy("user_id", "product_id").agg(*pair_aggregates(), *extra)
    # A product that only occurs in the target order was never bought before: no candidate.
    return with_gaps(pairs.filter(F.col("n") > 0))


ROWS_PER_ORDER = 8  # expected of the first orders; more orders are taken if these have fewer
TEST = "target_is_test"  # 1 if the user's target order is a test order, else 0


# Features of the wider families that the user, the product, or user and category determine.
USER_SLOT = ["hour_user_reorder_prob", "week_user_reorder_prob"]
USER_TARGET = ["user_lastorder_interval", "user_lastorder_interval_ratio"]
USER_CATEGORY = ["aisle_user_reorder_prob", "dep_user_reorder_prob"]
PRODUCT_CATEGORY = ["prod_aisle_reorder_prob", "prod_dep_reorder_prob"]


def _some(columns: dict[str, Column], names: list[str]) -> dict[str, Column]:
    return {name: columns[name] for name in names}


@dataclass(frozen=True)
class FeatureTables:
    """What the matrices of training and test candidates are both joined from."""

    history: DataFrame
    pairs: DataFrame
    cube: DataFrame
    product_side: DataFrame
    targets: DataFrame


def feature_tables(
    history: DataFrame,
    targets: DataFrame,
    products: DataFrame,
    truth_lines: DataFrame | None = None,
    params: FeatureParams = FeatureParams(),
) -> FeatureTables:
    """Aggregate the history once, for all target orders.

    ``history`` holds the prior purchases of all users, with ``interval_accu`` and the
    columns of ``toward_target``. It is read three times, so it should be a stored table.
    """
    detail = products.select("product_id", "aisle_id", "department_id")
    pairs = materialise(
        matrix_pairs(history, targets, truth_lines).join(detail, "product_id", "left"), "pairs",
        by=TEST,
    )
    cube = materialise(time_cube(history), "cube")
    per_product = product_level(pairs)
    categories = product_category_level(
        per_product.select("product_id", F.col("prod_nrorder").alias("rcnt")), products
    )
    product_side = (
        per_product.join(categories, "product_id").join(product_profile(cube), "product_id")
        .withColumns(product_columns(params))
        .withColumns(_some(id_columns(params), PRODUCT_CATEGORY))
        .select(
            "product_id", "prod_order_gap", "prod_cnt", "prod_rcnt", "by_hour", "by_dow",
            *PRODUCT_FEATURES, *PRODUCT_CATEGORY,
        )
    )
    product_side = materialise(product_side, "products")
    return FeatureTables(history, pairs, cube, product_side, targets)


def matrix_of(
    tables: FeatureTables,
    eval_set: str,
    params: FeatureParams = FeatureParams(),
    folds: int = FOLDS,
) -> DataFrame:
    """The candidates of one evaluation set with all features.

    ``train`` comes with ``label`` and ``seed`` if the tables were built with truth.
    """
    targets = tables.targets.filter(F.col("eval_set") == eval_set).drop("eval_set")
    # User features need the rows of this set's users only; products have theirs from all.
    of_set = F.col(TEST) == int(eval_set == "test")
    pairs = tables.pairs.filter(of_set).drop(TEST)
    users = user_level(
        pairs,
        order_grain(tables.history.filter(of_set)),
        F.sum("n_reordered").alias("user_rcnt"),
        F.sum("prod_user_hour_rcnt").alias("user_hour_rcnt"),
        F.sum("prod_user_week_rcnt").alias("user_week_rcnt"),
    ).join(targets, "user_id")
    # Whatever depends on the user alone is computed here, once per user; the last projection is
    # left with the rest.
    users = (
        users.withColumns(user_columns())
        .withColumns(_some(time_columns(params), USER_SLOT))
        .withColumns(_some(target_columns(params), USER_TARGET))
        .select(
            "order_id", "user_id", "user_rcnt", "user_order_gap", "user_last_order",
            "target_number", "target_days", "target_dow", "target_hour",
            *USER_FEATURES, *USER_SLOT, *USER_TARGET,
        )
    )
    # Categories are narrow rows, nearly as many as pairs, and users wide ones: joined with each other
    # they would move all user features once per category. Each pair with both categories finds its one
    # row, so the left join keeps the same rows, and Spark leaves it out where no such count is asked for.
    rows = (
        pairs.filter("aisle_id is not null and department_id is not null")
        .join(user_category_level(pairs), ["user_id", "aisle_id", "department_id"], "left")
        .join(users, "user_id")
        .withColumns(_some(id_columns(params), USER_CATEGORY))
        .drop("user_aisle_rcnt", "user_dep_rcnt", "user_rcnt")
        .join(tables.product_side, "product_id")
        .withColumn("prod_user_rcnt", F.col("n_reordered"))
    )
    rows = with_slot_counts(
        with_slot_totals(
            rows,
            slot_totals(tables.cube, "order_hour_of_day", "hour_cnt"),
            slot_totals(tables.cube, "order_dow", "week_cnt"),
        )
    )
    columns = {
        **user_product_columns(params), **target_columns(params), **time_columns(params)
    }
    done = {*USER_SLOT, *USER_TARGET}
    features = [
        columns[name].alias(name) if name in columns and name not in done else F.col(name)
        for name in ALL_FEATURES
    ]
    if eval_set != "train" or "label" not in tables.pairs.columns:
        return rows.select(*KEYS, *features)
    matrix = rows.select(*KEYS, "label", *features)
    return with_folds(matrix, folds).select(*KEYS, "label", "seed", *ALL_FEATURES)


def of_first_orders(tables: FeatureTables, eval_set: str, rows: int) -> FeatureTables:
    """The tables with only those target orders, first by id, that hold the first ``rows`` rows of the matrix.

    Their users' pairs and history come along; what belongs to products stays that of all users. As some
    orders have no rows, orders are added until there are enough rows, or no more orders.
    """
    targets = tables.targets.filter(F.col("eval_set") == eval_set)
    orders = max(1, rows // ROWS_PER_ORDER)
    while True:
        last, found = targets.select("order_id").orderBy("order_id").limit(orders).agg(
            F.max("order_id"), F.count(F.lit(1))).first()
        # Stored: it is counted first, and no task then sorts or joins by more than these users.
        some = materialise(
            targets.filter((F.col("order_id") <= last) | F.col("order_id").isNull()), "first-targets")
        users = some.select("user_id")
        of_users = replace(
            tables, targets=some,
            pairs=materialise(tables.pairs.join(users, "user_id", "left_semi"), "first-pairs"),
            history=tables.history.join(users, "user_id", "left_semi"))
        if found < orders or matrix_of(of_users, eval_set).count() >= rows:
            return of_users
        orders *= 4


def feature_matrix(
    prior_lines: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    eval_set: str,
    truth_lines: DataFrame | None = None,
    candidates: DataFrame | None = None,
    params: FeatureParams = FeatureParams(),
    folds: int = FOLDS,
) -> DataFrame:
    """Matrix from canonical tables.

    Candidates follow from the history; pass ``candidates`` (with any label columns of their
    own) to keep only some of them.
    """
    orders = materialise(order_interval_accu(orders), "orders")
    targets = single_targets(orders)
    history = materialise(
        purchase_history(prior_lines, toward_target(orders, targets)), "history"
    )
    tables = feature_tables(history, targets, products, truth_lines, params)
    matrix = matrix_of(tables, eval_set, params, folds)
    if candidates is None:
        return matrix
    return candidates.join(matrix.drop("label", "seed"), KEYS)
