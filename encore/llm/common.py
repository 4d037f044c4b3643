"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are runs of digits, ASCII letters and everything beyond ASCII; all other bytes separate and
# become blanks, and A-Z become lower case.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
# Lower-case A-Z and leave every other byte.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: str) -> list[bytes]:
    """The words of a text in order; a null text has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores where the frame has such a column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def compact(df: DataFrame, name: str) -> DataFrame:
    """Store a frame that may be small or uneven: Spark first evens out its partitions by size."""
    return materialise(df.hint("rebalance"), name)


SAMPLE_ROWS = 20_000  # labelled rows that a classifier is fitted on, at most


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
    id_column: str = "doc_id", text_column: str = "text", limit: int = SAMPLE_ROWS,
) -> DataFrame:
    """(label, text) of up to ``limit`` labelled documents outside the held-out fold.

    The rows with the least hashes of their ids are taken, so the sample is fair and the same each
    time. Null ids and labels are left out; of repeated labels of a document the largest counts.
    """
    key = F.col(id_column)
    usable = labels.filter(
        key.isNotNull() & F.col(label).isNotNull() & (crc_fold(key, folds) != held_out)
    ).groupBy(key.alias("labelled_id")).agg(F.max(label).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(limit)
    texts = docs.select(key.alias("labelled_id"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(sample), "labelled_id").select("label", "text")  # few, short rows


def with_scores(
    docs: DataFrame, scores: Callable[[Iterator[list]], Iterator], folds: int, held_out: int,
    threshold: float, id_column: str, text_column: str,
) -> DataFrame:
    """id, ``held_out``, ``score``, ``predicted`` of each document.

    ``scores`` maps an iterator over lists of texts (null for none) to lists of scores.
    """

    def apply(batches):
        ids = []

        def texts():
            for batch in batches:
                ids.append(batch.column(0))
                yield batch.column(1).to_pylist()

        for values in scores(texts()):
            yield pa.RecordBatch.from_arrays(
                [ids.pop(0), pa.array(values, pa.float64())], names=["id", "score"])

    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    scored = read.mapInArrow(apply, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_column),
        F.coalesce(crc_fold(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
