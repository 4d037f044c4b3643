import numpy as np
import pyarrow.parquet as pq
import pytest

from encore.llm import embedding_dedup
from encore.llm.embedding_dedup import near_vectors


def plain(rows, threshold=0.9):
    """(id, links, component) by comparing all pairs."""
    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v, float) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    for size in {len(u) for u in units if u is not None}:
        at = [i for i, u in enumerate(units) if u is not None and len(u) == size]
        table = np.array([units[i] for i in at])
        near[np.ix_(at, at)] = table @ table.T >= threshold
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(near[i]):
            a, b = label[i], label[j]
            if a != b:
                label = [a if x == b else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [(i, int(n), least.get(x)) for (i, _), n, x in zip(rows, near.sum(1), label, strict=True)]


def case():
    draw = np.random.default_rng(8)
    rows, centres = [], draw.standard_normal((60, 16))
    for k, c in enumerate(centres):
        for j in range([1, 2, 3, 8][k % 4]):
            rows.append((1000 - 10 * k - j, (c + draw.standard_normal(16) * 0.25 * (j > 0)).tolist()))
    wide = centres[3] + draw.standard_normal((300, 16)) * 0.35  # some pairs near, some not
    rows += [(5000 + i, v.tolist()) for i, v in enumerate(wide)]
    rows += [(9000 + i, [1.0, 2.0, 3.0]) for i in range(40)] + [(8000, [2.0, 4.0, 6.0])]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None]), (5, [float("nan")] * 16),
             (6, [float("inf")] + [1.0] * 15), (None, centres[0].tolist()), (None, [1.0, 0.0, 0.0]),
             (7, [1e300] * 16), (11, [1e-300] * 16)]
    return rows + [rows[0]]


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = case()
    table = spark.createDataFrame(
        [(i, v, "x", 1) for i, v in rows],
        "vec_id long, embedding array<double>, vector string, weight int").repartition(4)
    found = sorted(map(tuple, near_vectors(table).collect()), key=str)
    wanted = sorted(((i, n, c, i is not None and i == c) for i, n, c in plain(rows)), key=str)
    assert found == wanted
    assert near_vectors(table.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    loaded = pq.read_table(path)
    rows = list(zip(loaded["vec_id"].to_pylist(), loaded["embedding"].to_pylist(), strict=True))
    # The table has hardly any near pairs: add some just over the threshold.
    draw = np.random.default_rng(9)
    near = []
    for i, v in rows[:1000]:
        v = np.array(v)
        side = draw.standard_normal(len(v))
        side -= side @ v / (v @ v) * v
        side *= np.linalg.norm(v) / np.linalg.norm(side)
        near.append((100_000 + i, (0.905 * v + np.sqrt(1 - 0.905**2) * side).tolist()))
    table = spark.createDataFrame(rows + near, "vec_id long, embedding array<float>")
    found = {r.vec_id: r.n_links for r in near_vectors(table).collect()}
    wanted = {i: n for i, n, _ in plain(rows + near)}
    assert all(found[i] <= wanted[i] for i in wanted)
    assert sum(found.values()) >= 0.98 * sum(wanted.values()) > 1900


def test_recall_in_a_topic(spark):
    """A third of the table has a direction in common: isolated near pairs in it are found."""
    draw = np.random.default_rng(10)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, pairs, dimension = 15_000, 500, 64
    topic = unit(draw.standard_normal(dimension))
    inside = unit(np.sqrt(0.75) * topic + np.sqrt(0.25) * unit(draw.standard_normal((n, dimension))))
    side = draw.standard_normal((pairs, dimension))
    # The partner differs within the topic's own directions.
    side -= (side @ topic)[:, None] * topic
    side -= (side * inside[:pairs]).sum(1, keepdims=True) * inside[:pairs]
    twins = 0.905 * inside[:pairs] + np.sqrt(1 - 0.905**2) * unit(side)
    vectors = np.concatenate([inside, twins, unit(draw.standard_normal((2 * n, dimension)))])
    table = spark.createDataFrame(
        [(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.component_id for r in near_vectors(table.repartition(8)).collect()}
    joined = sum(found[i] == found[n + i] for i in range(pairs))
    assert joined >= 0.9 * pairs


@pytest.mark.parametrize("side", [8192, 100])
def test_no_link_is_lost_by_the_passes(spark, monkeypatch, side):
    """One pass over a window of one row leaves most near pairs apart: they are found all the same."""
    monkeypatch.setattr(embedding_dedup, "SIDE_ROWS", side)
    rows = case()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = sorted(map(tuple, near_vectors(table, passes=1, window=1).collect()), key=str)
    assert found == sorted(((i, n, c, i is not None and i == c) for i, n, c in plain(rows)), key=str)
