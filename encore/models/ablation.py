"""Drop-one ablation: AUC over the folds with all features and without each one.

Every trial is a fit. Its result goes into a ledger, a folder with a small file for each (run, dropped,
fold) that is there as a whole or not at all: a driver that is lost goes on where it stopped, and trials
that are done are never fitted again. The matrix is assembled into vectors once, with one dictionary of
categories; a trial leaves a feature out by slicing the vector.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.config import ABLATION_FEATURES, ALL_FEATURES, FOLDS, KEYS, GbtParams
from encore.models.rounds import fit_with_patience
from encore.models.trees import assembled, fit_without
from encore.operators.prepare import kfold
from encore.session import materialise, scratch
from encore.sources import hadoop

BASELINE = "Baseline"
TRIAL = "dropped string, fold int, rounds int, auc double, seconds double"
PARALLEL_FITS = 8  # a round is several short jobs, between which executors wait for the driver


def _name(dropped: str, fold: int) -> str:
    return f"{dropped}-{fold}.json"


def trials(spark: SparkSession, ledger: str, run: str) -> DataFrame:
    """What the ledger holds of a run: dropped, fold, rounds kept, AUC, seconds."""
    folder = f"{ledger.rstrip('/')}/run={run}"
    if not any(name.endswith(".json") for name in hadoop.names(spark, folder)):
        return spark.createDataFrame([], TRIAL)
    return spark.read.schema(TRIAL).option("pathGlobFilter", "*.json").json(folder)


def ablate(
    matrix: DataFrame,
    candidates: Sequence[str] = ABLATION_FEATURES,
    params: GbtParams = GbtParams(),
    features: Sequence[str] = ALL_FEATURES,
    folds: int = FOLDS,
    ledger: str | None = None,
    run: str = "ablation",
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """(feature, auc): the mean over the folds with all features (``Baseline``), then without each one.

    With a ``ledger`` folder the trials of an earlier call of the same ``run`` count, so it has to be
    the same matrix and the same parameters. A fold without both classes has no AUC and is left out of the mean.
    """
    spark = matrix.sparkSession
    ledger = (ledger or scratch(spark, "ledger")).rstrip("/")
    done = set(hadoop.names(spark, f"{ledger}/run={run}"))
    wanted = [(dropped, fold) for dropped in [BASELINE, *candidates] for fold in range(folds)]
    missing = [trial for trial in wanted if _name(*trial) not in done]
    if missing:
        vectors, bins = assembled(matrix.select(*KEYS, "seed", "label", *features), features, params)
        splits = {fold: (train, valid) for fold, train, valid in
                  kfold(materialise(vectors, "vectors", by="seed"), folds)}

        def fit(trial):
            dropped, fold = trial
            train, valid = splits[fold]
            place = None if dropped == BASELINE else features.index(dropped)
            began = time.time()
            model, metrics = fit_with_patience(
                train, [], valid, params, sides=["valid"],
                fit=lambda rows, sized: fit_without(rows, place, sized, bins))
            kept = model.stages[-1].getNumTrees
            auc = metrics.filter((F.col("side") == "valid") & (F.col("round") == kept)).first()["auc"]
            hadoop.put(spark, f"{ledger}/run={run}/{_name(dropped, fold)}", json.dumps({
                "dropped": dropped, "fold": fold, "rounds": kept, "auc": auc,
                "seconds": round(time.time() - began, 3)}))

        with ThreadPoolExecutor(parallel) as pool:
            for _ in pool.map(fit, missing):
                pass
    order = spark.createDataFrame(
        [(i, name) for i, name in enumerate([BASELINE, *candidates])], "place int, feature string")
    means = trials(spark, ledger, run).filter(F.col("fold") < folds).groupBy(
        F.col("dropped").alias("feature")).agg(F.avg("auc").alias("auc"))
    return order.join(means, "feature", "left").orderBy("place").select("feature", "auc")
