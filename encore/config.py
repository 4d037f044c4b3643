"""Parameters of the operators. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# The five-fold layout, the decision threshold and the two brackets
# from which thresholds are searched, with the tolerances of the search.
FOLDS = 5
DECISION_THRESHOLD = 0.177
ENSEMBLE_BRACKET = (0.15, 0.25)
TUNING_BRACKET = (0.15, 0.2)
ENSEMBLE_TOLERANCE, TUNING_TOLERANCE = 1e-5, 1e-2
DEBUG_ROWS = 10_000
REFIT_ROUNDS = 160  # of the model on all labelled rows, once the features are chosen

KEYS = ["order_id", "user_id", "product_id"]

# The feature columns, by family, in the order they are written.
USER_FEATURES = [
    "user_norder", "user_avg_prod_norder", "user_order_interval_avg", "user_days_interval_avg",
    "user_nitems", "user_ndistinctitems", "user_nritems", "user_nrdistinctitems",
    "user_interval", "user_second_order_rate", "user_avg_reorder_ratio",
    "user_nritem_ratio", "user_nrdistinctitem_ratio", "user_nitem_per_order",
    "user_nritem_per_order", "user_nritem_per_order_ratio",
]
PRODUCT_FEATURES = [
    "prod_nuser", "prod_norder", "prod_nruser", "prod_nrorder", "prod_days_interval_avg",
    "prod_order_interval_avg", "prod_second_order_ratio", "prod_ruser_ratio",
    "prod_rorder_ratio", "prod_rorder_per_ruser", "prod_order_per_user",
]
USER_PRODUCT_FEATURES = [
    "user_prod_norder", "user_prod_order_interval", "user_prod_days_interval",
    "user_prod_reorder_rate", "user_prod_reordered", "user_prod_recentlydiscovered",
    "user_prod_order_interval_user_ratio", "user_prod_order_interval_prod_ratio",
    "user_prod_days_interval_user_ratio", "user_prod_days_interval_prod_ratio",
    "user_prod_norder_user_ratio",
]
TARGET_FEATURES = [
    "user_lastorder_interval", "user_lastorder_interval_ratio",
    "user_prod_lastorder_interval", "user_prod_lastdays_interval",
    "user_prod_lastorder_interval_rate", "user_prod_lastdays_interval_rate",
]
TIME_FEATURES = [
    "order_dow", "order_hour_of_day", "prod_hour_prob", "prod_week_prob", "week_prod_prob",
    "hour_prod_prob", "hour_user_reorder_prob", "week_user_reorder_prob",
    "hour_prod_reorder_prob", "week_prod_reorder_prob", "hour_prod_user_reorder_prob",
    "week_prod_user_reorder_prob",
]
ID_FEATURES = [
    "aisle_id", "department_id", "aisle_user_reorder_prob", "dep_user_reorder_prob",
    "prod_aisle_reorder_prob", "prod_dep_reorder_prob",
]
ALL_FEATURES = (
    USER_FEATURES + PRODUCT_FEATURES + USER_PRODUCT_FEATURES + TARGET_FEATURES
    + TIME_FEATURES + ID_FEATURES
)

# Columns treated as categories, and those left out of the holdout split.
CATEGORICAL = [
    "aisle_id", "department_id", "order_dow", "order_hour_of_day", "user_prod_reordered",
    "user_prod_recentlydiscovered",
]
CATEGORY_VALUES = 10_000  # of all category features, at most
HOLDOUT_DROPPED = [
    "user_prod_recentlydiscovered", "hour_prod_user_reorder_prob", "prod_norder",
    "user_prod_order_interval", "week_prod_user_reorder_prob", "order_hour_of_day",
    "user_nritem_ratio", "user_prod_days_interval_prod_ratio", "user_prod_days_interval",
    "order_dow", "prod_week_prob", "department_id", "prod_dep_reorder_prob",
]

# The features that the drop-one ablation goes through, in its order.
ABLATION_FEATURES = [
    "user_prod_recentlydiscovered", "hour_prod_user_reorder_prob", "user_prod_order_interval",
    "week_prod_user_reorder_prob", "user_nritem_ratio", "prod_norder", "prod_order_per_user",
    "prod_nruser", "prod_ruser_ratio", "user_prod_days_interval",
    "user_prod_days_interval_prod_ratio", "prod_week_prob", "user_nrdistinctitem_ratio",
    "prod_hour_prob", "order_dow", "prod_dep_reorder_prob",
    "user_prod_order_interval_prod_ratio", "user_prod_order_interval_user_ratio",
    "user_prod_norder", "prod_nrorder", "department_id", "user_prod_days_interval_user_ratio",
    "order_hour_of_day", "prod_aisle_reorder_prob", "prod_nuser", "hour_prod_reorder_prob",
    "prod_rorder_per_ruser", "week_prod_reorder_prob", "week_prod_prob",
    "user_prod_lastorder_interval_rate", "user_prod_norder_user_ratio", "user_nritems",
    "prod_rorder_ratio", "aisle_id", "hour_prod_prob", "user_avg_prod_norder", "user_nitems",
    "user_prod_reorder_rate", "user_nrdistinctitems", "aisle_user_reorder_prob",
    "user_prod_lastorder_interval", "dep_user_reorder_prob",
]


@dataclass(frozen=True)
class FeatureParams:
    """Stand-ins for undefined values and the constants of the smoothed shares."""

    days_gap: float = 366.0
    order_gap: float = 100.0
    order_ratio: float = 80.0
    days_ratio: float = 366.0
    rate_ratio: float = 1600.0
    # The first two look swapped (24 hours, 7 days); they are kept, as results depend on them.
    dow_given_product: int = 24
    hour_given_product: int = 7
    hours: int = 24
    days: int = 7
    aisles: int = 134
    departments: int = 21


@dataclass(frozen=True)
class GbtParams:
    """Boosted trees. Depth 8 gives up to 256 leaves, the nearest to a limit of 224 leaves."""

    rounds: int = 200
    depth: int = 8
    min_rows: int = 4500
    feature_fraction: float = 0.7
    row_fraction: float = 1.0
    step: float = 0.1
    min_improvement: float = 0.001
    patience: int = 20  # rounds without a gain in AUC
    first_rounds: int = 50  # fitted before all of them, in case patience runs out within these
    max_bins: int = 256
    seed: int = 7


@dataclass(frozen=True)
class ForestParams:
    """Random forest with row and feature subsampling."""

    trees: int = 200
    l1: float = 0.03125  # of the leaves fitted by ``refit.forest_l1``
    depth: int = 11
    min_rows: int = 20
    feature_fraction: float = 0.5
    row_fraction: float = 0.6
    max_bins: int = 256
    seed: int = 7


@dataclass(frozen=True)
class SearchSpace:
    """One parameter and the values a sweep tries: ``l2``, or a field of ``GbtParams``."""

    name: str = "l2"
    values: tuple = field(default=(0.03125, 0.25, 1.0, 4.0, 16.0))
