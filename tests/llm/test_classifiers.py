from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.llm import quality, toxicity
from encore.llm.common import labelled_sample, table

SF_DIR = "/root/testdata/sf0.1"


def rates(found, labels, label):
    """Of the held-out labelled rows: share of label 1 and of label 0 that are predicted as such."""
    known = found.join(labels, "doc_id").filter(f"held_out and {label} is not null")
    cells = {(r[label], r.predicted): r.n for r in known.groupBy(label, "predicted").agg(
        F.count("*").alias("n")).collect()}
    one = cells.get((1, 1), 0) / max(1, cells.get((1, 1), 0) + cells.get((1, 0), 0))
    zero = cells.get((0, 0), 0) / max(1, cells.get((0, 0), 0) + cells.get((0, 1), 0))
    return one, zero


@pytest.mark.parametrize("operator,label,least,folds,held", [
    (toxicity.toxicity, "toxic", 0.75, 4, 2), (quality.quality, "quality", 0.98, 5, 0)])
def test_held_out_accuracy(spark, operator, label, least, folds, held):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    found = operator(docs, labels).cache()
    assert found.count() == docs.count()
    one, zero = rates(found, labels, label)
    assert one >= least and zero >= 0.98
    for r in found.select("doc_id", "held_out", "score", "predicted").limit(300).collect():
        assert r.held_out == (crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_odd_rows(spark, operator):
    rows = [(1, None), (2, ""), (None, "plain words"), (4, "word " * 60_000), (4, "word " * 60_000),
            (5, "x" * 300_000)] + [(100 + i, f"good text number {i}") for i in range(40)] + [
        (200 + i, f"nasty awful text {i}") for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows],
                                 "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame(
        [(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(40)]
        + [(None, 1, 1), (1, None, None), (100, 1, 0)], "doc_id long, quality int, toxic int")
    found = operator(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert sum(r.doc_id is None and not r.held_out for r in found) == 1
    assert operator(docs.limit(0), labels).count() == 0
    assert len({r.score for r in operator(docs, labels.limit(0)).collect()}) == 1


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_scores_do_not_depend_on_the_layout(spark, operator):
    small = "/root/testdata/sf0.001"
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    one, other = (
        {r.doc_id: r.score for r in operator(d, labels).collect()}
        for d in (docs, docs.repartition(5, F.xxhash64("text"))))
    assert one.keys() == other.keys()
    assert all(other[i] == pytest.approx(score, abs=1e-6) for i, score in one.items())


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    sample = labelled_sample(docs.select("doc_id", F.col("doc_id").cast("string").alias("text")),
                             labels, "toxic", 4, 2, limit=500).collect()
    assert len(sample) == 500
    assert all(crc32(r.text.encode()) % 4 != 2 for r in sample)


def test_label_model_discounts_echoes():
    draw = np.random.default_rng(4)
    y = draw.random(20_000) < 0.1
    lone = np.where(y, draw.random(len(y)) < 0.6, draw.random(len(y)) < 0.02)
    echo = np.where(y, draw.random(len(y)) < 0.6, draw.random(len(y)) < 0.02)
    votes = np.column_stack([lone, echo, echo, echo]).astype(float)
    votes = np.column_stack([votes, votes.any(axis=1)])
    model = toxicity.model_from(toxicity.moments(votes, np.ones(len(y)), y.astype(float)), 5)
    assert model.rates[1, :4] == pytest.approx([0.6] * 4, abs=0.05)
    one, three = model.posterior(np.array([[1, 0, 0, 0, 1], [0, 1, 1, 1, 1]], float))
    assert abs(one - three) < 0.1


def test_choice_ignores_other_words_of_copies():
    class Row:
        def __init__(self, label, found):
            self.label, self.found = label, found

    rows = [Row(1, [0, 1])] * 50 + [Row(1, [0, 2])] * 5 + [Row(0, [3])] * 9 + [Row(1, [3])]
    assert toxicity.choose(rows, 4, 10)[0] == 0
    assert 3 not in toxicity.choose(rows, 4, 10)


def test_temperature_and_contexts():
    draw = np.random.default_rng(5)
    x = draw.standard_normal((3000, 6))
    y = (draw.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, y, epochs=30)
    p = net.probabilities(x)
    assert abs(p[p > 0.8].mean() - y[p > 0.8].mean()) < 0.08
    contexts, tokens = quality.Contexts(), quality.Tokens()
    contexts.add(tokens.of("a b c"))
    contexts.add(tokens.of("d"))
    contexts.flush()
    assert contexts.words.sum() == contexts.shapes.sum() == 6  # ab ac ba bc ca cb, none across
