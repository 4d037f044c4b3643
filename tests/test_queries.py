"""Every query that has SQL against DuckDB, and the plans behind the queries."""

import functools

import pytest
from check_oracle import compare, connect
from conftest import SF_DIR

from encore.plans import catalog, oracle

SQL = oracle.oracle_sql()


@functools.cache
def duckdb():
    return connect(SF_DIR)


def derived(retail):
    """The stored tables, nothing else kept between queries."""
    copy = object.__new__(catalog.Retail)
    copy.__dict__.update(retail.__dict__)
    return copy


# Results of models, which SQL does not have; test_model_queries.py has their properties.
MODELS = {
    "gbt_scores", "gbt_scores_without_validation", "forest_scores", "forest_l1_scores", "feature_importance",
    "gbt_round_losses", "gbt_refit_scores", "parameter_sweep", "fixed_threshold_submission",
    "vote_submission", "vote_first_fold_users", "vote_first_fold_records",
}
SLOW = {"model_roundtrip", "model_text_roundtrip"}  # fits at full strength: in test_model_queries.py with fewer rounds


@pytest.mark.parametrize("name", sorted(SQL.keys() - SLOW))
def test_matches_sql(retail, name):
    got = catalog.comparable(catalog.QUERIES[name](derived(retail))).toPandas()
    assert compare(got, duckdb().sql(SQL[name]).df()) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - MODELS == set(SQL)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["user_features", "product_features", "time_features",
                                  "id_features", "feature_matrix_train", "legacy_matrix",
                                  "best_threshold_exact", "roc_auc", "submission"])
def test_plans_stay_inside_spark(retail, name):
    text = plan(catalog.QUERIES[name](derived(retail)))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoop"):
        assert word not in text


def test_pruning_and_pushdown(retail):
    text = plan(catalog.QUERIES["case_user_rows"](derived(retail)))
    assert "PushedFilters: [" in text
    counts = plan(catalog.QUERIES["hour_counts"](derived(retail)))
    assert "product_id" not in counts.split("ReadSchema: ")[1].split(">")[0]


def test_shares_add_up(retail):
    from pyspark.sql import functions as F

    for name, key, share in [
        ("product_dow_smoothed", "product_id", "week_prob"),
        ("product_hour_smoothed", "product_id", "hour_prob"),
        ("user_dow_share", "user_id", "user_week_prob"),
        ("user_hour_share", "user_id", "user_hour_prob"),
    ]:
        sums = catalog.QUERIES[name](retail).groupBy(key).agg(F.sum(share).alias("s"))
        assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


def test_queries_of_a_session_share_stored_tables(spark, tmp_path):
    import shutil

    source = tmp_path / "sf"
    shutil.copytree(SF_DIR, source)
    run = catalog.queries()
    before = len(catalog.LAYERS)
    first = run["user_features"](spark, str(source)).count()
    layer = catalog.layer_of(spark, str(source))
    stored = dict(layer)
    assert stored and len(catalog.LAYERS) == before + 1
    assert run["product_features"](spark, str(source)).count() > 0
    assert {name: layer[name] for name in stored} == stored
    # Other files, other tables; and stored tables that were removed are made again.
    for path in stored.values():
        shutil.rmtree(path.removeprefix("file:"))
    assert run["user_features"](spark, str(source)).count() == first
    shutil.copy(f"{SF_DIR}/part.parquet", source / "part.parquet")
    assert catalog.layer_of(spark, str(source)) == {}
