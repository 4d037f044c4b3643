"""Properties of the fitted models; scores are not reproducible in SQL."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from encore.config import ALL_FEATURES, GbtParams, SearchSpace
from encore.functions.columns import fold_of
from encore.models import ablation, rounds, search, trees, voting
from encore.operators import prepare, scoring
from encore.operators.thresholds import best_threshold_exact
from encore.session import materialise

SMALL = GbtParams(rounds=3, depth=3, min_rows=5)
FEATURES = ["user_prod_reorder_rate", "user_prod_norder", "prod_rorder_ratio", "aisle_id",
            "prod_hour_prob", "user_prod_reordered"]


@pytest.fixture(scope="module")
def matrix(retail):
    return materialise(retail.matrix("train"), "matrix")


def test_matrix_has_all_features(matrix):
    assert matrix.columns == ["order_id", "user_id", "product_id", "label", "seed", *ALL_FEATURES]
    assert len(ALL_FEATURES) == 62


def test_fit_score_save_load(spark, matrix, tmp_path):
    train, valid = prepare.holdout(matrix, drop=())
    model = trees.fit_gbt(train, FEATURES, SMALL, valid)
    scored = trees.score(model, valid, FEATURES)
    assert scored.count() == valid.count()
    assert scored.filter(~F.col("pred_prob").between(0, 1)).isEmpty()
    # Missing values must not be dropped or turn into scores that are NULL.
    assert scored.filter(F.col("pred_prob").isNull()).isEmpty()
    trees.save_model(model, str(tmp_path / "model"))
    again = trees.score(trees.load_model(str(tmp_path / "model")), valid, FEATURES, "again")
    both = scored.join(again.select("order_id", "product_id", "again"), ["order_id", "product_id"])
    assert both.filter("pred_prob <> again").isEmpty()

    shares = trees.importances(model, FEATURES, spark).collect()
    assert [r["feature"] for r in shares] == FEATURES
    assert sum(r["importance"] for r in shares) == pytest.approx(1)


def test_metrics_of_each_round(matrix):
    train, valid = prepare.holdout(matrix, drop=())
    model, metrics = rounds.fit_with_patience(
        train, FEATURES, valid, GbtParams(rounds=6, depth=3, min_rows=5, patience=2))
    found = metrics.orderBy("side", "round").collect()
    assert [(r["side"], r["round"]) for r in found] == [
        (side, i) for side in ("train", "valid") for i in range(1, 7)]
    on_train = [r["loss"] for r in found if r["side"] == "train"]
    assert on_train == sorted(on_train, reverse=True)
    aucs = [r["auc"] for r in found if r["side"] == "valid"]
    kept = rounds.rounds_to_keep(aucs, 2)
    assert len(model.stages[-1].trees) == kept and aucs[kept - 1] == max(aucs[:kept])
    # The last round of the kept model is what its own scores say.
    scored = trees.score(model, valid, FEATURES)
    assert scoring.roc_auc(scored).first()["auc"] == pytest.approx(aucs[kept - 1], abs=1e-12)
    prepared = trees.filled(valid.select(*FEATURES, "label"), FEATURES)
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    losses = model.stages[-1].evaluateEachIteration(prepared)
    assert [r["loss"] for r in found if r["side"] == "valid"][:kept] == pytest.approx(losses)


def test_patience():
    assert rounds.rounds_to_keep([0.5, 0.6, 0.7, 0.69, 0.7, 0.9], patience=2) == 3
    assert rounds.rounds_to_keep([0.5, 0.6, 0.7, 0.69, 0.9], patience=2) == 5
    assert rounds.rounds_to_keep([None, None], patience=1) == 2


def test_unseen_category_is_scored(matrix):
    train, valid = prepare.holdout(matrix, drop=())
    model = trees.fit_gbt(train.filter("aisle_id < 10"), FEATURES, SMALL)
    odd = valid.filter("aisle_id >= 10")
    assert trees.score(model, odd, FEATURES).count() == odd.count() > 0


def test_forest_beats_chance_on_its_rows(matrix):
    from encore.config import ForestParams

    model = trees.fit_forest(matrix, FEATURES, ForestParams(trees=5, depth=4, min_rows=2))
    scored = trees.score(model, matrix, FEATURES)
    assert scoring.roc_auc(scored).first()["auc"] > 0.6


def test_folds_must_fit_the_matrix(matrix):
    with pytest.raises(ValueError, match="outside folds"):
        list(prepare.kfold(matrix, folds=2))


def test_sweep_of_a_parameter(matrix):
    matrix = matrix.withColumn("seed", fold_of(F.col("user_id"), 2))
    swept = search.tune(matrix, SearchSpace("step", (0.1, 0.3)), SMALL, FEATURES, folds=2)
    assert [r["param"] for r in swept.collect()] == [0.1, 0.3]
    assert swept.filter(F.col("f1").between(0, 1) & F.col("auc").between(0, 1)).count() == 2


def test_ablation_goes_on_where_it_stopped(spark, matrix, tmp_path, monkeypatch):
    matrix = matrix.withColumn("seed", fold_of(F.col("user_id"), 2))
    ledger, fitted = str(tmp_path / "ledger"), []
    put = ablation.hadoop.put

    def dies(session, path, text):
        if len(fitted) == 3:
            raise KeyboardInterrupt  # the driver is lost before this trial is in the ledger
        fitted.append(path)
        put(session, path, text)

    def ablate():
        return ablation.ablate(
            matrix, ["aisle_id", "prod_hour_prob"], SMALL, FEATURES, folds=2, ledger=ledger, parallel=1)

    with monkeypatch.context() as broken:
        broken.setattr(ablation.hadoop, "put", dies)
        with pytest.raises(KeyboardInterrupt):
            ablate()
    assert ablation.trials(spark, ledger, "ablation").count() == 3
    fits = []
    whole = ablation.fit_without
    monkeypatch.setattr(ablation, "fit_without", lambda *a: fits.append(a[1]) or whole(*a))
    report = {r["feature"]: r["auc"] for r in ablate().collect()}
    assert list(report) == ["Baseline", "aisle_id", "prod_hour_prob"] and len(fits) == 3
    assert report == {r["feature"]: r["auc"] for r in ablate().collect()} and len(fits) == 3
    # Without a feature, by slicing the vector, is a fit on the other features.
    names = [name for name in FEATURES if name != "aisle_id"]
    aucs = []
    for _, train, valid in prepare.kfold(matrix, 2):
        model, _ = rounds.fit_with_patience(train, names, valid, SMALL, sides=["valid"])
        aucs.append(scoring.roc_auc(trees.score(model, valid, names)).first()["auc"])
    assert report["aisle_id"] == pytest.approx(sum(aucs) / 2, abs=0.02)


def test_vote_run_goes_on_where_it_stopped(spark, retail, matrix, tmp_path, monkeypatch):
    test, folder = materialise(retail.matrix("test"), "test"), str(tmp_path / "run")
    matrix = matrix.withColumn("seed", fold_of(F.col("user_id"), 3))
    first = voting.VoteRun(matrix, folder, SMALL, FEATURES, 3)
    first.fold(0), first.fold(2)
    fits = []
    fit = voting.fit_with_patience
    monkeypatch.setattr(voting, "fit_with_patience", lambda *a, **k: fits.append(1) or fit(*a, **k))
    run = voting.VoteRun(matrix, folder, SMALL, FEATURES, 3)
    assert [r["name"][0] for r in run.all_folds()] == list("012") and len(fits) == 1
    baskets = {r["order_id"]: r["products"] for r in run.baskets(test).collect()}
    orders = {r["order_id"] for r in test.select("order_id").distinct().collect()}
    assert baskets.keys() == orders and any(p != "None" for p in baskets.values())
    votes = Counter()
    for fold in range(3):
        least = run.fold(fold)["threshold"]
        assert best_threshold_exact(run.scored(fold)).first()["threshold"] == least
        for r in trees.score(run.model(fold), test, FEATURES).filter(F.col("pred_prob") > least).collect():
            votes[r["order_id"], r["product_id"]] += 1
    wanted = {order: [] for order in orders}
    for (order, product), count in sorted(votes.items()):
        if count > 2:
            wanted[order].append(str(product))
    assert baskets == {order: " ".join(p) or "None" for order, p in wanted.items()}
    paths = run.write_outputs(test)
    lines = open(paths["baskets"]).read().splitlines()
    assert len(lines) == len(orders) + 1 and len(fits) == 1
    valid = matrix.filter("seed = 0")
    assert run.users().count() == valid.select("user_id").distinct().count()
    assert spark.read.option("sep", "\t").option("header", True).csv(paths["records"]).count() == valid.count()
    assert spark.read.option("sep", "\t").option("header", True).csv(paths["model"]).count() > 3
    assert search.single_submission(matrix, test, SMALL, FEATURES).count() == len(orders)


def test_many_categories_get_bins(matrix):
    train = matrix.withColumn("aisle_id", F.col("product_id") % 300)
    model = trees.fit_gbt(train, ["aisle_id"], GbtParams(rounds=1, depth=1, min_rows=1, max_bins=8))
    assert trees.score(model, train, ["aisle_id"]).count() == train.count()


def test_folds_share_a_dictionary_of_categories(spark, matrix):
    values = prepare.category_values(prepare.category_dictionary(matrix))
    few = matrix.filter("aisle_id < 5")
    model = trees.fit_gbt(few, ["aisle_id", "user_prod_norder"], replace(SMALL, rounds=2), values=values)
    assert list(model.stages[0].labelsArray[0]) == values["aisle_id"]
    # The indexer of the model and the coded frame agree, unseen values and NULL included.
    odd = few.limit(1).withColumn("aisle_id", F.lit(-7).cast(few.schema["aisle_id"].dataType))
    none = few.limit(1).withColumn("aisle_id", F.lit(None).cast(few.schema["aisle_id"].dataType))
    rows = trees.filled(matrix.unionByName(odd).unionByName(none), ["aisle_id"])
    indexed = model.stages[0].transform(rows)
    compared = prepare.coded(indexed.withColumn("order_dow", F.col("aisle_id")),
                             {"aisle_id": values["aisle_id"]}, ["aisle_id"])
    assert compared.filter(~F.col("_x_aisle_id").eqNullSafe(F.col("aisle_id").cast("double"))).isEmpty()
    with pytest.raises(ValueError, match="more than 3"):
        prepare.category_values(prepare.category_dictionary(matrix), limit=3)
