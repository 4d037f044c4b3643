import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from encore.llm import queries, rules
from encore.llm.common import crc_fold, table

SF_DIR = "/root/testdata/sf0.1"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def own_counts(text):
    data = (text or "").encode()
    words = data.split()
    return (len(words), *rules.base_counts(text or "", data, words))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ü#", "\n", " ", "\t", "\x0b", "a b\n", "|", " ", " ", "x"]), max_size=60))
def test_counts_equal_brute_force(parts):
    text = "".join(p + " " * (i % 3 == 0) for i, p in enumerate(parts))
    assert own_counts(text) == plain_counts(text)


def test_counts_of_repeats():
    assert rules.repeated_words([b"a"] * 9) == 9
    assert rules.repeated_words([b"a"] * 8) == 0
    block = [b"%d" % i for i in range(8)]
    assert rules.repeated_words(block + [b"x"] + block + [b"y"]) == 16
    draw = random.Random(1)
    for _ in range(50):
        text = " ".join(draw.choice("abc") for _ in range(draw.randint(0, 300)))
        assert own_counts(text) == plain_counts(text)


def test_pieces_give_the_same_grams(monkeypatch):
    text = "Größe und Länge, " * 40
    words, hashed = text.encode().split(), rules.Words()

    def counted():
        totals = np.zeros((len(rules.FAMILIES), rules.ROWS), int)
        for family, found in rules.grams(text, words, hashed):
            totals[family] += np.bincount(found, minlength=rules.ROWS)
        return totals

    whole = counted()
    assert whole.sum(axis=1).tolist() == [len(words), len(words) - 1, len(text) - 2, len(text) - 3]
    for piece in (1, 5, 64):
        monkeypatch.setattr(rules, "PIECE", piece)
        assert (counted() == whole).all()


def test_margin_is_the_trained_one():
    draw, hashed = np.random.default_rng(3), rules.Words()
    good = [" ".join(draw.choice(["calm", "river", "stone", "light"], 30)) for _ in range(200)]
    bad = [" ".join(draw.choice(["buy!!", "$$$", "river", "now##"], 30)) for _ in range(200)]
    y = np.array([1.0] * 200 + [0.0] * 200)
    found = rules.train([rules.features(t, hashed) for t in good + bad], y)
    p = [found.probability(found.margin(t, t.encode().split(), hashed)) for t in good + bad]
    assert min(p[:200]) > 0.8 and max(p[200:]) < 0.2


def test_platt_is_calibrated():
    draw = np.random.default_rng(4)
    x = 5 * draw.standard_normal(20_000)
    y = (draw.random(len(x)) < 1 / (1 + np.exp(-(0.4 * x + 0.7)))).astype(float)
    slope, shift = rules.platt(x, y)
    assert slope == pytest.approx(0.4, abs=0.02) and shift == pytest.approx(0.7, abs=0.06)


def test_held_out_rows_of_the_query(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    found = queries.QUERIES["op12_quality_rules"](spark, SF_DIR).cache()
    assert found.count() == docs.count()
    known = found.join(labels, "doc_id").filter(
        (crc_fold(F.col("doc_id"), 5) == 0) & F.col("quality").isNotNull())
    cells = {(r.quality, r.kept): r["count"] for r in known.groupBy("quality", "kept").count().collect()}
    print(cells, found.groupBy("verdict").count().collect())
    failed = {r.quality: r["count"] for r in known.filter("base_failed").groupBy("quality").count().collect()}
    good = cells.get((1, True), 0) / (cells.get((1, True), 0) + cells.get((1, False), 0) - failed.get(1, 0))
    bad = cells.get((0, False), 0) / (cells.get((0, True), 0) + cells.get((0, False), 0))
    assert good >= 0.98 and bad >= 0.9
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found.collect()[::9]:
        own = plain_counts(texts[r.doc_id]) if len(texts[r.doc_id]) < 4000 else own_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        assert r.kept == (not r.base_failed and r.score >= 0.3)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "plain words " * 12), (4, "word " * 60_000), (4, "word " * 60_000),
            (5, "x" * 300_000), (6, "\n" * 9)] + [(100 + i, f"good text number {i} " * 9) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows],
                                 "doc_id long, text string, score int, kept string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(None, 1), (1, None)],
                                   "doc_id long, quality int")
    found = rules.quality_rules(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    again = rules.quality_rules(docs.repartition(5), labels).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))  # whatever the layout
    assert rules.quality_rules(docs.limit(0), labels).count() == 0
    unlabelled = rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in unlabelled)
