"""Registered queries: each operator over the star-schema tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.config import (
    ALL_FEATURES,
    CATEGORICAL,
    DEBUG_ROWS,
    DECISION_THRESHOLD,
    ENSEMBLE_BRACKET,
    ENSEMBLE_TOLERANCE,
    HOLDOUT_DROPPED,
    KEYS,
    REFIT_ROUNDS,
    TUNING_BRACKET,
    TUNING_TOLERANCE,
    ForestParams,
    GbtParams,
)
from encore.models import refit, rounds, search, text, trees, voting
from encore.operators import (
    baseline,
    candidates,
    categories,
    earlier,
    history,
    matrix,
    pairs,
    prepare,
    products,
    scoring,
    submission,
    targets,
    thresholds,
    timeofweek,
    users,
)
from encore.session import materialise, scratch, tune
from encore.sources import files, hadoop, schemas, star

# Columns that come from an average of ratios. The order of summation shows in their last
# digits, so they are rounded to nine decimals to be comparable between engines.
AVERAGED = {
    "user_order_interval_avg", "user_days_interval_avg", "user_avg_reorder_ratio",
    "prod_days_interval_avg", "prod_order_interval_avg",
    "user_prod_order_interval_user_ratio", "user_prod_order_interval_prod_ratio",
    "user_prod_days_interval_user_ratio", "user_prod_days_interval_prod_ratio", "mean_f1",
}
# Continuous features of the holdout training rows.
SCALED = [
    name for name in ALL_FEATURES if name not in CATEGORICAL and name not in HOLDOUT_DROPPED
]
BOOSTED, FOREST = GbtParams(), ForestParams()
BRACKETS = [("tuning", TUNING_BRACKET, TUNING_TOLERANCE), ("ensemble", ENSEMBLE_BRACKET, ENSEMBLE_TOLERANCE)]


def grid_values() -> list[float]:
    return thresholds.grid(*ENSEMBLE_BRACKET, steps=20)


def comparable(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in df.columns if n in AVERAGED})


LAYERS: dict[tuple, dict[str, str]] = {}


def layer_of(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Paths of the canonical tables that queries of this application have stored of a folder's files.

    Files that were changed, added or removed make it another layer.
    """
    tables = ("orders", "lineitem", "part")
    files_now = tuple(hadoop.listing(spark, f"{sf_dir.rstrip('/')}/{name}.parquet") for name in tables)
    return LAYERS.setdefault((spark.sparkContext.applicationId, sf_dir, files_now), {})


class Retail:
    """Canonical tables of one folder, declared when first asked for.

    With ``store``, orders and purchases are written once and read back, for queries that use
    them more than once; with ``shared``, once for all queries of the application. Without, a query is
    a single plan over the raw tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool, shared: bool = False):
        self.spark, self.store = tune(spark), store
        self.star = star.Star.load(self.spark, sf_dir)
        self.layer = layer_of(self.spark, sf_dir) if store and shared else {}

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """The stored frame, as an earlier query of the session has stored it if it did."""
        if not self.store:
            return df
        path = self.layer.get(name)
        if path is None or not hadoop.exists(self.spark, f"{path}/_SUCCESS"):
            path = self.layer[name] = scratch(self.spark, name)
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    @cached_property
    def orders(self) -> DataFrame:
        return self._kept(star.canonical_orders(self.star), "orders")

    @cached_property
    def accu_orders(self) -> DataFrame:
        return self._kept(history.order_interval_accu(self.orders), "accu-orders")

    @cached_property
    def purchases(self) -> DataFrame:
        return self._kept(
            star.all_purchases(self.star, self.orders), "purchases"
        )

    def order_products(self, eval_set: str) -> DataFrame:
        bought = star.all_purchases(self.star, self.orders, cart=True)
        return star.order_products(bought, eval_set)

    @cached_property
    def prior_lines(self) -> DataFrame:
        return self.history.select("order_id", "product_id", "reordered")

    @cached_property
    def truth_lines(self) -> DataFrame:
        return self.purchases.filter("eval_set = 'train'").select(
            "order_id", "product_id", "reordered"
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._kept(star.canonical_products(self.star), "products")

    @cached_property
    def history(self) -> DataFrame:
        """Prior purchases with their order's context, without the running day count."""
        if self.store:
            return star.prior(self.purchases)
        return star.history(self.star, self.orders)

    @cached_property
    def accu_history(self) -> DataFrame:
        if "purchases" in self.__dict__:  # stored already: no second scan of the lines
            return self._kept(
                history.purchase_history(self.prior_lines, self.accu_orders), "history")
        return self._kept(
            star.history(self.star, self.accu_orders), "history"
        )

    @cached_property
    def train(self) -> DataFrame:
        return self._candidates("train")

    @cached_property
    def test(self) -> DataFrame:
        return self._candidates("test")

    def _candidates(self, eval_set: str) -> DataFrame:
        return candidates.candidates(
            self.orders, candidates.user_products(self.history), eval_set
        )

    @cached_property
    def labelled(self) -> DataFrame:
        return candidates.labelled(self.train, self.truth_lines)

    @cached_property
    def scored(self) -> DataFrame:
        return baseline.reorder_rate_scores(self.labelled, self.history)

    @cached_property
    def test_scored(self) -> DataFrame:
        return baseline.reorder_rate_scores(self.test, self.history)

    @cached_property
    def all_candidates(self) -> DataFrame:
        return self.train.unionByName(self.test)

    @cached_property
    def tables(self) -> matrix.FeatureTables:
        orders = self.accu_orders
        # Stored, so that the join can be split where one user has very many orders.
        wanted = materialise(matrix.single_targets(orders), "targets")
        ahead = matrix.toward_target(orders, wanted)
        if "purchases" in self.__dict__:
            bought = materialise(history.purchase_history(self.prior_lines, ahead), "history")
            return matrix.feature_tables(bought, wanted, self.products, self.truth_lines)
        bought = materialise(star.all_purchases(self.star, ahead), "purchases")
        return matrix.feature_tables(
            star.prior(bought), wanted, self.products, bought.filter("eval_set = 'train'")
        )

    def matrix(self, eval_set: str) -> DataFrame:
        return matrix.matrix_of(self.tables, eval_set)

    def first_rows(self, eval_set: str, rows: int) -> DataFrame:
        """The matrix's first rows by key; only orders that can be among them get features."""
        first = matrix.of_first_orders(self.tables, eval_set, rows)
        return prepare.debug_sample(matrix.matrix_of(first, eval_set), rows)

    @cached_property
    def worst(self) -> DataFrame:
        return scoring.worst_user(scoring.user_debug_metrics(self.scored, DECISION_THRESHOLD))


Query = Callable[[Retail], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def register(name: str, function: Query) -> None:
    QUERIES[name] = function


# Queries that read each canonical table once; the others store them first.
SINGLE_USE = {
    "canonical_orders", "canonical_order_products", "canonical_order_products_train",
    "canonical_products", "orders_csv_roundtrip", "order_products_csv_roundtrip",
    "products_csv_roundtrip", "user_products", "fold_assignment", "hour_counts", "dow_counts",
    "product_counts", "product_hour_counts", "product_dow_counts", "user_reorder_counts",
    "user_hour_counts", "user_dow_counts", "user_product_reorder_counts",
    "user_product_hour_counts", "user_product_dow_counts", "user_aisle_counts",
    "user_department_counts", "product_aisle_counts", "product_department_counts",
    "aisle_counts", "department_counts", "product_reorder_stats", "product_reorder_rate",
    "product_user_reorder", "product_reorder_gap", "product_dow_smoothed",
    "product_hour_smoothed", "user_dow_share", "user_hour_share", "user_interval_avg",
}

# Sources.
register("canonical_orders", lambda t: t.orders)
register("canonical_order_products", lambda t: t.order_products("prior"))
register("canonical_order_products_train", lambda t: t.order_products("train"))
register("canonical_products", lambda t: t.products)


def _delimited(t: Retail, df: DataFrame, name: str, sep: str) -> str:
    path = scratch(t.spark, name)
    files.write_delimited(df, path, sep)
    return path


@query
def orders_csv_roundtrip(t):
    return files.read_orders(t.spark, _delimited(t, t.orders, "orders", ","))


@query
def order_products_csv_roundtrip(t):
    return files.read_order_products(t.spark, _delimited(t, t.order_products("prior"), "lines", ","))


@query
def products_csv_roundtrip(t):
    return files.read_products(t.spark, _delimited(t, t.products, "products", ","))


@query
def candidates_tsv_roundtrip(t):
    rows = candidates.with_folds(t.labelled)
    return files.read_candidates(t.spark, _delimited(t, rows, "train", "\t"), labelled=True)


@query
def test_candidates_tsv_roundtrip(t):
    return files.read_candidates(t.spark, _delimited(t, t.test, "test", "\t"), labelled=False)


@query
def indexed_tsv_roundtrip(t):
    rows = scoring.scored_rows(t.scored, DECISION_THRESHOLD)
    indexed = rows.select(F.monotonically_increasing_id().alias(" "), *rows.columns)
    path = _delimited(t, indexed, "records", "\t")
    return files.read_indexed_tsv(t.spark, path, schemas.SCORED)


@query
def dataset_parquet_roundtrip(t):
    path = scratch(t.spark, "dataset")
    files.write_dataset(t.matrix("train"), t.matrix("test"), path)
    train, test = (
        files.read_dataset(t.spark, path, split).withColumn("split", F.lit(split))
        for split in ("train", "test")
    )
    both = train.unionByName(test, allowMissingColumns=True)
    # Test rows have neither; doubles show that as the same missing value everywhere.
    return both.withColumns({name: F.col(name).cast("double") for name in ("label", "seed")})


@query
def submission_csv_roundtrip(t):
    baskets = submission.submission(scoring.thresholded(t.test_scored, DECISION_THRESHOLD))
    path = files.write_submission(baskets, scratch(t.spark, "submission"))
    return files.read_csv(t.spark, path, schemas.SUBMISSION)


@query
def submission_file_roundtrip(t):
    baskets = submission.submission(scoring.thresholded(t.test_scored, DECISION_THRESHOLD))
    path = files.write_submission_file(baskets, scratch(t.spark, "submission"))
    return files.read_csv(t.spark, path, schemas.SUBMISSION)


@query
def dataset_replaced_key(t):
    """Keys of both matrices after the training one was replaced by its holdout rows."""
    path = scratch(t.spark, "dataset")
    files.write_dataset(t.matrix("train"), t.matrix("test"), path)
    # The version that is replaced stays readable, so the rows need no other copy.
    files.replace_split(files.read_dataset(t.spark, path, "train").filter("seed < 2"), path, "train")
    parts = [files.read_dataset(t.spark, path, split).select(F.lit(split).alias("split"), *KEYS)
             for split in ("train", "test")]
    return parts[0].unionByName(parts[1])


# Candidates and history.
register("user_order_products",
         lambda t: candidates.user_order_products(t.prior_lines, t.orders))
register("user_products", lambda t: candidates.user_products(t.history))
register("train_candidates", lambda t: t.train)
register("train_labelled", lambda t: t.labelled)
register("fold_assignment", lambda t: candidates.fold_assignment(t.orders))
register("test_candidates", lambda t: t.test)
register("order_interval_accu", lambda t: t.accu_orders)
register("purchase_history",
         lambda t: history.purchase_history(t.prior_lines, t.accu_orders))
register("purchase_occurrence", lambda t: history.purchase_occurrence(t.accu_history))

# User, product and pair features.
register("user_features", lambda t: users.user_features(t.accu_history))
register("product_features", lambda t: products.product_features(t.accu_history))
register("user_product_features", lambda t: pairs.user_product_features(t.accu_history))
register("user_product_last", lambda t: history.user_product_last(t.accu_history))
register("target_order_features", lambda t: targets.target_order_features(
    t.all_candidates, t.accu_orders, t.accu_history))


# Time-of-week features.
def _lines(keys, count, reorders=None):
    return lambda t: timeofweek.line_counts(t.history, keys, count, reorders)


def _reorders(keys, name):
    return lambda t: timeofweek.reorder_counts(t.history, keys, name)


register("hour_counts", _lines(["order_hour_of_day"], "hour_cnt"))
register("dow_counts", _lines(["order_dow"], "week_cnt"))
register("product_counts", _lines(["product_id"], "prod_cnt", "prod_rcnt"))
register("product_hour_counts",
         _lines(["product_id", "order_hour_of_day"], "prod_hour_cnt", "prod_hour_rcnt"))
register("product_dow_counts",
         _lines(["product_id", "order_dow"], "prod_week_cnt", "prod_week_rcnt"))
register("user_reorder_counts", _reorders(["user_id"], "user_rcnt"))
register("user_hour_counts", _reorders(["user_id", "order_hour_of_day"], "user_hour_rcnt"))
register("user_dow_counts", _reorders(["user_id", "order_dow"], "user_week_rcnt"))
register("user_product_reorder_counts", _reorders(["product_id", "user_id"], "prod_user_rcnt"))
register("user_product_hour_counts",
         _reorders(["product_id", "user_id", "order_hour_of_day"], "prod_user_hour_rcnt"))
register("user_product_dow_counts",
         _reorders(["product_id", "user_id", "order_dow"], "prod_user_week_rcnt"))
register("time_features",
         lambda t: timeofweek.time_features(t.all_candidates, t.orders, t.history))


# Aisle and department features.
def _category(keys, name):
    return lambda t: categories.category_reorders(t.history, t.products, keys, name)


register("user_aisle_counts", _category(["user_id", "aisle_id"], "user_aisle_rcnt"))
register("user_department_counts", _category(["user_id", "department_id"], "user_dep_rcnt"))
register("product_aisle_counts", _category(["product_id", "aisle_id"], "prod_aisle_rcnt"))
register("product_department_counts",
         _category(["product_id", "department_id"], "prod_dep_rcnt"))
register("aisle_counts", _category(["aisle_id"], "aisle_cnt"))
register("department_counts", _category(["department_id"], "dep_cnt"))
register("id_features",
         lambda t: categories.id_features(t.all_candidates, t.products, t.history))
register("user_affinity", lambda t: categories.user_affinity(t.history, t.products))

# Matrices.
register("feature_matrix_train", lambda t: t.matrix("train"))
register("feature_matrix_test", lambda t: t.matrix("test"))

# Earlier feature set.
for _name in (
    "product_reorder_stats", "product_reorder_rate", "product_user_reorder",
    "product_reorder_gap", "product_dow_share", "product_hour_share", "product_dow_smoothed",
    "product_hour_smoothed", "user_product_order_stats", "user_basket_stats", "user_dow_share",
    "user_hour_share",
):
    register(_name, lambda t, operator=getattr(earlier, _name): operator(t.history))
register("user_interval_avg", lambda t: earlier.user_interval_avg(t.orders))
register("legacy_matrix", lambda t: earlier.legacy_matrix(t.labelled, t.orders, t.history))
register("legacy_matrix_test", lambda t: earlier.legacy_matrix(t.test, t.orders, t.history))

# Training-set preparation.
register("category_codes", lambda t: prepare.category_dictionary(t.matrix("train")))


def _frame(split):
    """Rows of one split with the codes of the training rows."""
    def frame(t):
        train = t.matrix("train")
        if split == "train":  # read twice; test rows only need the categories of the training rows
            train = materialise(train, "matrix")
        values = prepare.category_values(prepare.category_dictionary(train))
        return comparable(prepare.training_frame(
            train if split == "train" else t.matrix("test"), values))
    return frame


register("training_frame", _frame("train"))
register("test_frame", _frame("test"))
register("cv_fold_counts", lambda t: prepare.fold_counts(t.matrix("train")))
register("debug_sample", lambda t: t.first_rows("train", DEBUG_ROWS))
register("debug_fold_counts",
         lambda t: prepare.fold_counts(t.first_rows("train", DEBUG_ROWS)))
register("holdout_split", lambda t: prepare.holdout_labelled(t.matrix("train")))
register("zero_based_ids", lambda t: prepare.zero_based_ids(t.matrix("train")).select(
    *KEYS, "aisle_id", "department_id", "order_dow", "order_hour_of_day"))


@query
def standardised_features(t):
    train, _ = prepare.holdout(t.matrix("train"))
    scaled = prepare.standardise(materialise(comparable(train), "matrix"), SCALED)
    return scaled.select(*KEYS, *[F.round(name, 9).alias(name) for name in SCALED])


@query
def one_hot_aisle(t):
    names = ["user_prod_reordered", "aisle_id"]
    train, _ = prepare.holdout(prepare.zero_based_ids(t.matrix("train")))
    vectors = prepare.one_hot(materialise(train.select(*names), "matrix"), names)
    totals = vectors.select(*[Summarizer.sum(F.col(f"{n}_vec")).alias(n) for n in names])
    by_feature = F.array(*[
        F.struct(F.lit(n).alias("feature"), vector_to_array(n).alias("rows")) for n in names])
    return totals.select(F.inline(by_feature)).select(
        "feature", F.posexplode("rows").alias("position", "rows")
    ).filter(F.col("rows") > 0)


# Evaluation.
register("thresholded_predictions",
         lambda t: scoring.thresholded(t.scored, DECISION_THRESHOLD).drop("label"))
register("scored_rows", lambda t: scoring.scored_rows(t.scored, DECISION_THRESHOLD))
register("per_user_f1", lambda t: scoring.per_user_f1(t.scored, DECISION_THRESHOLD))
register("mean_user_f1", lambda t: scoring.mean_user_f1(t.scored, DECISION_THRESHOLD))
register("user_debug_metrics",
         lambda t: scoring.user_debug_metrics(t.scored, DECISION_THRESHOLD))
register("roc_auc", lambda t: scoring.roc_auc(t.scored))
register("threshold_sweep", lambda t: thresholds.threshold_sweep(t.scored, grid_values()))
register("best_threshold", lambda t: thresholds.best_threshold(t.scored, grid_values()))


@query
def threshold_search(t):
    """Bracketed search with either bracket and tolerance."""
    found, scored = None, materialise(t.scored.select("user_id", "label", "pred_prob"), "scored")
    for name, bracket, tolerance in BRACKETS:
        one = thresholds.threshold_search(scored, *bracket, tolerance).select(
            F.lit(name).alias("bracket"), "threshold", "mean_f1", "passes")
        found = one if found is None else found.unionByName(one)
    return found


register("best_threshold_exact", lambda t: thresholds.best_threshold_exact(t.scored))
register("case_user_rows", lambda t: scoring.case_rows(
    scoring.scored_rows(t.scored, DECISION_THRESHOLD), t.worst))


@query
def case_user_product_history(t):
    first = scoring.case_rows(t.train, t.worst).groupBy("user_id").agg(
        F.min("product_id").alias("product_id")
    )
    return scoring.case_rows(t.accu_history, first)


@query
def case_order(t):
    case = scoring.case_rows(t.train, t.worst).select("order_id").distinct()
    return scoring.case_rows(t.orders, case)


# Votes and baskets, on five scores that need no model.
VOTERS = {
    "user_prod_reorder_rate": 0.05, "user_prod_order_rate": 0.15, "user_prod_order_freq": 0.3,
    "up_order_rate_since_first_order": 0.2, "recency": 0.25,
}


def _votes(t: Retail) -> DataFrame:
    rows = t.test_scored.withColumnRenamed("pred_prob", "user_prod_reorder_rate").join(
        earlier.user_product_order_stats(t.history), ["user_id", "product_id"]
    ).withColumn("recency", 1 / F.col("user_prod_last_order_vacancy"))
    return submission.ensemble_vote(rows, list(VOTERS), list(VOTERS.values()))


register("ensemble_vote", lambda t: _votes(t).select(*KEYS, "votes", "pred"))
register("vote_baskets", lambda t: submission.submission(_votes(t)))
register("submission", lambda t: submission.submission(
    scoring.thresholded(t.test_scored, DECISION_THRESHOLD)))


# Models, at full strength. SQL has no such scores, so tests check the rows and the range of the values.
def _holdout(t: Retail) -> tuple[DataFrame, DataFrame, list[str]]:
    train, valid = prepare.holdout(materialise(t.matrix("train"), "matrix"))
    return train, valid, [name for name in ALL_FEATURES if name in train.columns]


def _scores(scored: DataFrame, *columns: str) -> DataFrame:
    return scored.select(*KEYS, *columns, "pred_prob")


@query
def gbt_scores(t):
    train, valid, features = _holdout(t)
    model, _ = rounds.fit_with_patience(train, features, valid, BOOSTED, sides=["valid"])
    return _scores(trees.score(model, valid, features), "label")


@query
def gbt_scores_without_validation(t):
    train, valid, features = _holdout(t)
    model = trees.fit_gbt(train, features, BOOSTED)
    return _scores(trees.score(model, valid, features), "label")


@query
def forest_scores(t):
    train, valid, features = _holdout(t)
    model = trees.fit_forest(train, features, FOREST)
    return _scores(trees.score(model, valid, features), "label")


@query
def forest_l1_scores(t):
    train, valid, features = _holdout(t)
    model = trees.fit_forest(train, features, FOREST)
    scored = refit.forest_l1(model, train, valid, features, FOREST.l1, FOREST.row_fraction)
    return _scores(scored, "label")


@query
def feature_importance(t):
    train, _, features = _holdout(t)
    return trees.importances(trees.fit_gbt(train, features, BOOSTED), features, t.spark)


@query
def gbt_round_losses(t):
    train, valid, features = _holdout(t)
    model = trees.fit_gbt(train, features, BOOSTED)
    return rounds.round_metrics(model, {"train": train, "valid": valid}, features)


@query
def gbt_refit_scores(t):
    """Fixed number of rounds on training and validation rows together, then the test rows."""
    train, valid, features = _holdout(t)
    rows = prepare.refit_rows(train, valid)
    model = trees.fit_gbt(rows, features, replace(BOOSTED, rounds=REFIT_ROUNDS))
    return _scores(trees.score(model, t.matrix("test"), features))


@query
def model_roundtrip(t):
    """Rows that score otherwise once the model has been written and read: none."""
    train, valid, features = _holdout(t)
    path = scratch(t.spark, "model")
    model = trees.fit_gbt(train, features, BOOSTED, valid)
    trees.save_model(model, path)
    both = trees.score(trees.load_model(path), trees.score(model, valid, features), features, "again")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("again").eqNullSafe(F.col("pred_prob"))).alias("changed"))


@query
def parameter_sweep(t):
    """Mean F1 and AUC over the folds for each penalty on leaf values."""
    return search.tune(t.matrix("train"))


@query
def fixed_threshold_submission(t):
    return search.single_submission(t.matrix("train"), materialise(t.matrix("test"), "matrix"), BOOSTED)


@query
def vote_submission(t):
    return voting.vote_submission(t.matrix("train"), t.matrix("test"), BOOSTED)


@query
def vote_first_fold_users(t):
    """Metrics of the validation users of the vote's first fold."""
    return voting.VoteRun(t.matrix("train"), params=BOOSTED).users(0)


@query
def vote_first_fold_records(t):
    return voting.VoteRun(t.matrix("train"), params=BOOSTED).records(0)


@query
def model_text_roundtrip(t):
    """Rows that score otherwise from the model's text than from the model: none."""
    train, valid, features = _holdout(t)
    path = scratch(t.spark, "model-text")
    model = trees.fit_gbt(train, features, BOOSTED, valid)
    text.write_text(text.tree_table(model, features), path)
    table = text.read_text(t.spark, path)
    both = text.with_text_score(table, trees.score(model, valid, features), "again")
    same = F.abs(F.col("again") - F.col("pred_prob")) < 1e-9
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same | same.isNull()).alias("changed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(operator: Query, store: bool) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: comparable(operator(
            Retail(spark, sf_dir, store, shared=True)))

    return {name: bind(operator, name not in SINGLE_USE) for name, operator in QUERIES.items()}
