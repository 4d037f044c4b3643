"""Model queries, with fewer rounds: every row is there, and a constant model would not do."""

import functools
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_queries import derived

from encore.config import HOLDOUT_DROPPED, KEYS
from encore.models import search
from encore.operators import scoring
from encore.plans import catalog


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    quick = replace(catalog.BOOSTED, rounds=4, depth=3, min_rows=20)
    monkeypatch.setattr(catalog, "BOOSTED", quick)
    monkeypatch.setattr(catalog, "FOREST", replace(catalog.FOREST, trees=10, depth=6, min_rows=2))
    monkeypatch.setattr(catalog, "REFIT_ROUNDS", 3)
    monkeypatch.setattr(catalog.search, "tune", functools.partial(search.tune, params=quick))


def run(retail, name):
    return catalog.QUERIES[name](derived(retail)).cache()


@pytest.mark.parametrize("name", ["gbt_scores", "gbt_scores_without_validation", "forest_scores", "forest_l1_scores"])
def test_scores(retail, name):
    scored = run(retail, name)
    valid = retail.matrix("train").filter("seed = 3").select(*KEYS, "label")
    assert scored.count() == valid.count() == scored.join(valid, [*KEYS, "label"]).count()
    assert scored.filter(~F.col("pred_prob").between(0, 1) | F.col("pred_prob").isNull()).isEmpty()
    assert scored.select("pred_prob").distinct().count() > 4
    assert scoring.roc_auc(scored).first()["auc"] > (0.52 if name.startswith("forest") else 0.55)


def test_refit_scores(retail):
    scored = run(retail, "gbt_refit_scores")
    test = retail.matrix("test").select(*KEYS)
    assert scored.count() == test.count() == scored.join(test, KEYS).count()
    assert scored.select("pred_prob").distinct().count() > 4


def test_importance(retail):
    rows = run(retail, "feature_importance").collect()
    assert {r["feature"] for r in rows} == set(catalog.ALL_FEATURES) - set(HOLDOUT_DROPPED)
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    assert sum(r["importance"] > 0 for r in rows) > 2


def test_round_losses(retail):
    rows = run(retail, "gbt_round_losses").orderBy("round").collect()
    assert sorted((r["side"], r["round"]) for r in rows) == [(s, i) for s in ("train", "valid") for i in range(1, 5)]
    on_train = [r["loss"] for r in rows if r["side"] == "train"]
    assert on_train == sorted(on_train, reverse=True) and on_train[0] > on_train[-1]
    assert all(0.5 < r["auc"] < 1 for r in rows)


def test_sweep(retail):
    rows = run(retail, "parameter_sweep").collect()
    assert sorted(r["param"] for r in rows) == [0.03125, 0.25, 1, 4, 16]
    assert all(0 <= r["f1"] <= 1 and 0.5 < r["auc"] < 1 for r in rows)
    assert len({r["auc"] for r in rows}) > 1


def test_text_roundtrip(retail):
    row = run(retail, "model_text_roundtrip").first()
    assert row["rows"] > 0 and row["changed"] == 0


def test_first_fold(retail):
    users, records = run(retail, "vote_first_fold_users"), run(retail, "vote_first_fold_records")
    valid = retail.matrix("train").filter("seed = 0")
    assert records.count() == valid.count() == records.join(valid.select(*KEYS), KEYS).count()
    assert users.count() == valid.select("user_id").distinct().count()
    assert records.filter("pred = 1").count() > 0 and users.filter("f1 > 0").count() > 0


def test_baskets(retail):
    test = retail.matrix("test").cache()
    for name in ("fixed_threshold_submission", "vote_submission"):
        baskets = run(retail, name)
        assert baskets.select("order_id").distinct().count() == baskets.count()
        assert baskets.join(test.select("order_id").distinct(), "order_id").count() == baskets.count()
        assert baskets.filter("products <> 'None'").count() > 0
        chosen = baskets.filter("products <> 'None'").select(
            "order_id", F.explode(F.split("products", " ").cast("array<long>")).alias("product_id"))
        assert chosen.join(test, ["order_id", "product_id"]).count() == chosen.count()
