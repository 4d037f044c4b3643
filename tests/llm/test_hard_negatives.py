import math

import numpy as np
import pytest

from encore.llm import hard_negatives, queries
from encore.llm.common import table

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """By the definition, with Python's integers."""
    part = []
    for vec, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = [math.floor(256 * float(np.float32(c))) for c in x]
        part.append((vec, q, (label + 1) % 10 if vec is not None and vec % 7 == 0 else label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (anchor, q, label) in enumerate(part):
        if anchor is None or anchor % 50:
            continue
        score = [(sum(x * y for x, y in zip(q, other, strict=True)), vec, own)
                 for i, (vec, other, own) in enumerate(part) if i != a and len(other) == len(q)]
        for p, positive, own in sorted((s for s in score if s[2] == label), key=order)[:5]:
            negatives = [s for s in score if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(anchor, positive, rank, s[1], p, s[0])
                    for rank, s in enumerate(sorted(negatives, key=order)[:3], start=1)]
    return sorted(out, key=repr)


def compare(spark, rows):
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = plain(rows)
    assert sorted(map(tuple, found), key=repr) == expected
    return expected


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "embeddings").select("vec_id", "embedding", "label").collect()]
    found = queries.QUERIES["op13_hard_negatives"](spark, SF_DIR).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows) and len(found) > 50


def test_ties_and_repeats(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.integers(-2, 3, 4).astype(float).tolist(), int(draw.integers(0, 3))) for i in range(300)]
    rows += rows[:60] + [(None, [2.0, 2.0, 1.0, 0.0], 1), (50, [1.0, 1.0, 1.0, 1.0], 2), (50, [1.0, 1.0, 1.0, 1.0], 2)]
    assert len(compare(spark, rows)) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, None, 1), (150, [nan, 1.0], 1), (200, [None, 1.0], 1), (250, [inf, 1.0], 2),
            (1, [1.0, 0.25], 1), (2, [0.8, 0.1], 2), (3, [0.8, 0.1], None), (4, [], 3), (300, [], 3), (5, [], 4),
            (6, [3.0], 3), (350, [0.3], 3), (8, [2.0], 4), (50, [1e6, 2e6], 5), (9, [1e6, 2e6], 5), (10, [9e5, 1e6], 4)]
    assert compare(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 as row", "2 as shard", "3 as score", "4 as rank")
    assert hard_negatives.hard_negatives(clash).count() == len(plain(rows))


def test_shards_give_the_same(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.standard_normal(6) / 3).tolist(), int(draw.integers(0, 4))) for i in range(500)]
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 37)
    assert compare(spark, rows)


@pytest.mark.parametrize("depth", [1, 3, 32])
def test_any_depth_gives_the_same(monkeypatch, depth):
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", depth)
    draw = np.random.default_rng(depth)
    for _ in range(60):
        vectors = draw.integers(-4, 5, (draw.integers(1, 90), draw.integers(1, 7)))
        ids = draw.permutation(len(vectors))
        shard = hard_negatives.Shard(ids, np.arange(len(ids)), np.zeros(len(ids), int), vectors)
        anchor, allowed = draw.integers(-4, 5, vectors.shape[1]), draw.random(len(ids)) < 0.7
        windows = [(None, None), (3, 20), (-10, 2), (50, 40)]
        every = vectors @ anchor
        for best, (least, most) in zip(shard.search(anchor, allowed, windows, 3), windows, strict=True):
            inside = [(int(s), r) for r, s in enumerate(every) if allowed[r] and (
                least is None or least <= s <= most)]
            assert best == sorted(inside, key=lambda x: (-x[0], ids[x[1]]))[:3]


def test_reading_stops_early():
    """Where one dimension rules, few rows are scored."""
    draw = np.random.default_rng(3)
    vectors = np.column_stack([draw.integers(0, 100_000, 5000), draw.integers(0, 3, 5000)])
    ids = np.arange(5000)
    shard = hard_negatives.Shard(ids, ids, np.zeros(5000, int), vectors)
    scored = []
    scores = shard.scores
    shard.scores = lambda anchor, rows: scored.append(len(rows)) or scores(anchor, rows)
    anchor = np.array([50, 1])
    best = shard.search(anchor, np.ones(5000, bool), [(None, None)], 5)[0]
    every = vectors @ anchor
    assert best == [(int(every[r]), r) for r in np.lexsort((ids, -every))[:5]]
    assert sum(scored) < 400


def test_windows():
    for p in (-7, 0, 1, 3, 10, 101, 65536):
        least, most = hard_negatives.window(p)
        inside = [s for s in range(-50, 70_000) if 50 * p <= 100 * s <= 95 * p]
        assert inside == list(range(least, most + 1))


@pytest.mark.parametrize("rows,cores,shards", [(0, 8, 1), (500, 8, 1), (51_282, 6, 6), (10**7, 6, 77)])
def test_shard_count(rows, cores, shards):
    assert hard_negatives.shard_count(rows, cores) == shards
