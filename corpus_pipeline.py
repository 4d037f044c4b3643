"""From raw documents to packed training sequences, as five stages that each store their result.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept:

1. ``quality``: the classifier's rejects go;
2. ``near_dedup``: one document of each SimHash component stays, the one of the smallest id;
3. ``repeats``: passages that start earlier in the corpus are cut out, documents that lose all their text go;
4. ``decontaminate``: documents with a benchmark passage go;
5. ``pack``: what is left becomes sequences.

All but the last return the columns of ``documents``, further ones included, whatever their names.

Null texts count as empty. Texts without words are near copies of each other, so one of them all stays;
the other stages leave them alone. Rows without an id are kept, cut and packed like others; where they
are near copies, a row with an id stays first. Rows that repeat as a whole leave one after the second
stage. Empty documents go through all stages as empty tables. Without labels of both classes the first
stage gives all rows one score; an empty benchmark keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm import decontaminate, packing, quality, repeats, simhash
from encore.llm.common import table
from encore.session import materialise, tune


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(docs, drop_emptied=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(
        docs, size=packing.token_estimate(F.col("text")), cluster=packing.copy_cluster(F.col("text")))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("repeats", cut_repeats),
    ("decontaminate", keep_clean),
    ("pack", pack),
]
ORACLE_SQL = None  # SQL expresses neither a trained classifier nor best-fit packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
