"""From the feature matrix to training, validation and test frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from encore.config import CATEGORICAL, CATEGORY_VALUES, DEBUG_ROWS, FOLDS, HOLDOUT_DROPPED, KEYS


def prepare(matrix: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """The matrix without the features that are not to be used."""
    return matrix.drop(*drop)


def category_dictionary(matrix: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(feature, value, code, rows): codes of each category feature, the most frequent value first.

    Values are text, ties go by it. One aggregate counts all features by grouping sets; whole numbers
    become text after it. Only counts are ranked. NULL has no entry.
    """
    def grouped(name):
        whole = isinstance(matrix.schema[name].dataType, IntegralType)
        return F.col(name) if whole else F.col(name).cast("string").alias(name)

    sets = matrix.select(*[grouped(name) for name in columns]).groupingSets(
        [[F.col(name)] for name in columns], *columns,
    ).agg(F.count(F.lit(1)).alias("rows"), *[F.grouping(name).alias(f"_not_{name}") for name in columns])
    feature, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in columns:
        of = F.col(f"_not_{name}") == 0
        feature = F.when(of, F.lit(name)).otherwise(feature)
        value = F.when(of, F.col(name).cast("string")).otherwise(value)
    counts = sets.select(feature.alias("feature"), value.alias("value"), "rows").filter("value is not null")
    ranked = Window.partitionBy("feature").orderBy(F.desc("rows"), "value")
    return counts.select(
        "feature", "value", (F.row_number().over(ranked) - 1).alias("code"), "rows")


def category_values(dictionary: DataFrame, limit: int = CATEGORY_VALUES) -> dict[str, list[str]]:
    """The values of each feature in the order of their codes.

    They become literals and bins of trees, so a dictionary of more than ``limit`` is refused.
    """
    found = dictionary.select("feature", "value", "code").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} values of category features")
    values: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda row: row["code"]):
        values.setdefault(row["feature"], []).append(row["value"])
    return values


def coded(
    matrix: DataFrame, values: dict[str, list[str]], columns: Sequence[str] = CATEGORICAL,
) -> DataFrame:
    """The rows with codes instead of categories; a value that has none, or NULL, gets the next code."""

    def code(name):
        known = values.get(name, [])
        if not known:
            return F.lit(0)
        codes = F.create_map(*[F.lit(x) for pair in zip(known, range(len(known)), strict=True) for x in pair])
        # A missing key gives NULL, and NULL is no key.
        return F.coalesce(F.try_element_at(codes, F.coalesce(F.col(name).cast("string"), F.lit(""))),
                          F.lit(len(known)))

    return matrix.withColumns({name: code(name) for name in columns if name in matrix.columns})


def training_frame(
    matrix: DataFrame, values: dict[str, list[str]], drop: Sequence[str] = ()
) -> DataFrame:
    """All labelled rows for a fit, or test rows for its scores: categories as codes, no dropped features."""
    return coded(prepare(matrix, drop), values)


def kfold(matrix: DataFrame, folds: int = FOLDS) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(fold, train, valid) for each fold; a user is in one fold only.

    Rows of other folds would never be validated, so they raise an error.
    """
    other = matrix.filter(~F.col("seed").between(0, folds - 1) | F.col("seed").isNull())
    if not other.isEmpty():
        raise ValueError(f"the matrix has rows outside folds 0 to {folds - 1}")
    for fold in range(folds):
        yield fold, matrix.filter(F.col("seed") != fold), matrix.filter(F.col("seed") == fold)


def fold_counts(matrix: DataFrame) -> DataFrame:
    """Rows and positives of each fold."""
    return matrix.groupBy("seed").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives")
    )


def debug_sample(matrix: DataFrame, rows: int = DEBUG_ROWS) -> DataFrame:
    """The first rows by key, for trying things out."""
    return matrix.orderBy(*KEYS).limit(rows)


def holdout(matrix: DataFrame, drop: Sequence[str] = HOLDOUT_DROPPED) -> tuple[DataFrame, DataFrame]:
    """Train on folds 0 and 1, validate on fold 3, without the weakest features."""
    kept = prepare(matrix, drop)
    return kept.filter(F.col("seed") < 2), kept.filter(F.col("seed") == 3)


def holdout_labelled(matrix: DataFrame) -> DataFrame:
    """Both sides of the holdout in one frame, told apart by ``split``."""
    split = F.when(F.col("seed") < 2, "train").when(F.col("seed") == 3, "valid")
    return prepare(matrix, HOLDOUT_DROPPED).withColumn("split", split).filter("split is not null")


def refit_rows(train: DataFrame, valid: DataFrame) -> DataFrame:
    """All labelled rows, for the fit that follows validation."""
    return train.unionByName(valid)


def zero_based_ids(matrix: DataFrame) -> DataFrame:
    """Codes minus one. Days and hours start at 0 already and so go to -1: kept as it is."""
    names = ["aisle_id", "department_id", "order_dow", "order_hour_of_day"]
    return matrix.withColumns({name: F.col(name) - 1 for name in names})


def standardise(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column becomes 0, NULL stays NULL.

    One pass over the rows for all moments. They come back as a single row and enter the
    second pass as literals, so that scaling is a projection.
    """
    moments = matrix.agg(
        *[F.avg(name).alias(f"mean_{name}") for name in columns],
        *[F.stddev_pop(name).alias(f"std_{name}") for name in columns],
    ).first()

    def scaled(name):
        mean, std = moments[f"mean_{name}"], moments[f"std_{name}"]
        if mean is None:
            return F.lit(None).cast("double")
        centred = F.col(name) - F.lit(float(mean))
        return centred * 0.0 if std == 0 else centred / F.lit(float(std))

    return matrix.withColumns({name: scaled(name) for name in columns})


def one_hot(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse 0/1 vectors, one per column, in ``<column>_vec``; codes are their positions."""
    encoder = OneHotEncoder(
        inputCols=list(columns),
        outputCols=[f"{name}_vec" for name in columns],
        dropLast=False,
        handleInvalid="error",
    )
    return encoder.fit(matrix).transform(matrix)
