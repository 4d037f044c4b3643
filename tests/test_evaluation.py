"""Metrics, thresholds and baskets against brute force in plain Python."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from shop import rows

from encore.functions.prefix import running_sums
from encore.operators import prepare, scoring, submission, thresholds
from encore.sources import schemas

SCORED = "order_id long, user_id long, product_id long, label int, pred_prob double"


def scored_rows(seed, users=9, hot=60, scores=None):
    """Random scores; user 0 holds about a third of all rows."""
    rng = random.Random(seed)
    data = []
    for user in range(users):
        for product in range(hot if user == 0 else rng.randint(1, 24)):
            score = rng.choice(scores) if scores else rng.random()
            data.append((user + 100, user, product, int(rng.random() < 0.3), score))
    return data


def mean_f1(data, t):
    users = {}
    for _, user, _, label, score in data:
        tp, n, actual = users.get(user, (0, 0, 0))
        users[user] = (tp + (label and score > t), n + (score > t), actual + label)
    return sum(2 * tp / (n + a) if n + a else 0 for tp, n, a in users.values()) / len(users)


def auc(data):
    pos = [s for *_, label, s in data if label]
    neg = [s for *_, label, s in data if not label]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed,scores", [(1, None), (2, [0.1, 0.2, 0.2001, 0.5]), (3, [0.4])])
def test_auc_and_best_threshold(spark, seed, scores):
    data = scored_rows(seed, scores=scores)
    df = spark.createDataFrame(data, SCORED)
    assert scoring.roc_auc(df).first()["auc"] == pytest.approx(auc(data), abs=1e-12)
    flipped = df.withColumn("pred_prob", -F.col("pred_prob"))
    assert scoring.roc_auc(flipped).first()["auc"] == pytest.approx(1 - auc(data), abs=1e-12)
    if scores == [0.4]:
        assert scoring.roc_auc(df).first()["auc"] == 0.5

    best = thresholds.best_threshold_exact(df).first()
    values = sorted({s for *_, s in data})
    brute = max(mean_f1(data, t) for t in [values[0] - 1, *values])
    assert best["mean_f1"] == pytest.approx(brute, abs=1e-9)
    assert mean_f1(data, best["threshold"]) == pytest.approx(brute, abs=1e-9)

    swept = thresholds.threshold_sweep(df, thresholds.grid(0, 1, 10)).collect()
    assert len(swept) == 11
    for row in swept:
        assert row["mean_f1"] == pytest.approx(mean_f1(data, row["threshold"]), abs=1e-12)
        assert row["mean_f1"] <= best["mean_f1"] + 1e-9
    grid_best = thresholds.best_threshold(df, thresholds.grid(0, 1, 10)).first()
    assert grid_best["mean_f1"] == pytest.approx(max(r["mean_f1"] for r in swept), abs=1e-9)


def test_auc_without_a_class_is_null(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, 0.2), (1, 1, 2, 0, 0.3)], SCORED)
    assert scoring.roc_auc(df).first()["auc"] is None


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0.177), (1, 1, 2, 1, 0.178)], SCORED)
    got = rows(scoring.thresholded(df, 0.177), "product_id")
    assert (got[1,]["pred"], got[2,]["pred"]) == (0, 1)


def test_user_without_positives_and_predictions(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, 0.1), (2, 2, 1, 1, 0.9), (2, 2, 2, 0, 0.9)], SCORED)
    got = rows(scoring.user_debug_metrics(df, 0.5), "user_id")
    assert [got[1,][m] for m in ("precision", "recall", "accuracy", "f1")] == [0, 0, 1, 0]
    assert [got[2,][m] for m in ("precision", "recall", "accuracy", "f1")] == [
        0.5, 1, 0.5, pytest.approx(2 / 3)
    ]
    assert scoring.worst_user(scoring.user_debug_metrics(df, 0.5)).first()["user_id"] == 1


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_running_sums_do_not_depend_on_chunks(spark, size):
    rng = random.Random(size)
    data = [(u, n, float(rng.randint(0, 9))) for u in range(4) for n in range(40 if u == 0 else 5)]
    df = spark.createDataFrame(data, "user long, n int, v double").repartition(3)
    plain = df.withColumns({
        "s": F.sum("v").over(W.partitionBy("user").orderBy("n")),
        "t": F.sum("v").over(W.partitionBy("user")),
    })
    got = running_sums(
        df, ["user"], [F.col("n")], F.floor(F.col("n") / size), {"s": F.col("v")}, {"s": "t"}
    )
    assert rows(got, "user", "n") == rows(plain, "user", "n")
    without = running_sums(
        df, ["user"], [F.col("n")], F.floor(F.col("n") / size), {"s": F.col("v")}
    )
    assert rows(without, "user", "n") == rows(plain.drop("t"), "user", "n")


def test_four_of_five_votes(spark):
    names = [f"s{i}" for i in range(5)]
    data = [(1, 1, 1, *[0.9] * 3, *[0.1] * 2), (1, 1, 2, *[0.9] * 4, 0.1)]
    df = spark.createDataFrame(
        data, "order_id long, user_id long, product_id long, " + ", ".join(f"{n} double" for n in names)
    )
    got = rows(submission.ensemble_vote(df, names, [0.5] * 5), "product_id")
    assert [(got[p,]["votes"], got[p,]["pred"]) for p in (1, 2)] == [(3, 0), (4, 1)]


def test_baskets(spark):
    df = spark.createDataFrame(
        [(1, 10, 1), (1, 9, 1), (1, 8, 0), (2, 9, 0)], "order_id long, product_id long, pred int"
    )
    got = rows(submission.submission(df), "order_id")
    assert got[1,]["products"] == "9 10"
    assert got[2,]["products"] == "None"


def test_standardise_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0)], "a double, b double, c double")
    got = prepare.standardise(df, ["a", "b", "c"]).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(-1, 0, None), (1, 0, 0)]


def test_folds_keep_users_together(spark, retail):
    from encore.operators.candidates import fold_assignment, with_folds

    labelled = with_folds(retail.labelled)
    assert labelled.groupBy("user_id").agg(F.countDistinct("seed").alias("n")).filter("n > 1").isEmpty()
    assert {r["seed"] for r in fold_assignment(retail.orders).collect()} == set(range(5))
    sides = [(t.count(), v.count()) for _, t, v in prepare.kfold(labelled)]
    assert {t + v for t, v in sides} == {labelled.count()}
    assert sum(v for _, v in sides) == labelled.count()


def test_submission_file(spark, tmp_path):
    from encore.sources import files

    df = spark.createDataFrame([(1, "9 10"), (2, "None")], schemas.SUBMISSION)
    path = files.write_submission(df, str(tmp_path))
    assert path.startswith(f"{tmp_path}/result_")
    assert rows(files.read_csv(spark, path, schemas.SUBMISSION), "order_id") == rows(df, "order_id")


def searched(data, low, high, tolerance, points):
    """The bracketed search in plain Python: (threshold, mean F1, passes)."""
    passes, start = 0, True
    while True:
        cuts = [round(low + (high - low) * i / (points - 1), 12) for i in range(points)]
        means = [round(mean_f1(data, t), 9) for t in cuts]
        passes += 1
        at = means.index(max(means))
        best = (cuts[at], means[at], passes)
        low, high = cuts[max(at - 1, 0)], cuts[min(at + 1, points - 1)]
        if start and at in (0, points - 1):
            low, high = (0.0, high) if at == 0 else (low, 1.0)
        elif cuts[1] - cuts[0] <= tolerance * (1 + 1e-6):
            return best
        start = False


@pytest.mark.parametrize("low,high,tolerance", [(0.15, 0.2, 1e-2), (0.15, 0.25, 1e-5), (0.7, 0.9, 1e-3)])
def test_threshold_search(spark, low, high, tolerance):
    groups = {g: scored_rows(g, scores=None if g else [0.1, 0.17, 0.2, 0.6]) for g in range(4)}
    df = spark.createDataFrame(
        [(*row, g) for g, data in groups.items() for row in data], SCORED + ", g int")
    found = thresholds.threshold_search(df, low, high, tolerance, by=["g"]).collect()
    assert len(found) == len(groups)
    for r in found:
        assert (r["threshold"], r["mean_f1"], r["passes"]) == searched(
            groups[r["g"]], low, high, tolerance, thresholds.POINTS)
        assert r["passes"] <= 5
    one = thresholds.threshold_search(df.filter("g = 1"), low, high, tolerance).first()
    assert tuple(one) == searched(groups[1], low, high, tolerance, thresholds.POINTS)
    assert thresholds.threshold_search(df.limit(0), low, high, tolerance).count() == 0


def test_threshold_search_query_scores_once(retail, monkeypatch):
    """Both brackets read the same stored rows."""
    from encore.plans import catalog

    read = []
    search = thresholds.threshold_search
    monkeypatch.setattr(thresholds, "threshold_search",
                        lambda scored, *rest: read.append(scored.inputFiles()) or search(scored, *rest))
    assert catalog.threshold_search(retail).count() == 2
    assert len(read) == 2 and read[0] == read[1] and all("scored" in path for path in read[0])
