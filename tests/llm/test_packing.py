import random
from collections import defaultdict

from pyspark.sql import functions as F

from encore.llm import packing
from encore.llm.packing import Bins, copy_cluster, pack, token_estimate


def test_tightest_bin_without_conflict():
    draw, capacity = random.Random(3), 100
    bins, held = Bins(capacity), []  # held: [residual, sources, clusters]
    pieces = sorted((draw.randint(1, 99) for _ in range(800)), reverse=True)
    for size in pieces:
        source, cluster = draw.choice([0, 1, 1, 2, 4, 8]), draw.choice([0, 1, 2, 4, 1 << 40])
        fits = [
            (b[0], n) for n, b in enumerate(held)
            if b[0] >= size and not b[1] & source and not b[2] & cluster
        ]
        wanted = min(fits)[1] if fits else len(held)
        if not fits:
            held.append([capacity, 0, 0])
        bin_, offset = bins.place(size, source, cluster)
        assert (bin_, offset) == (wanted, capacity - held[wanted][0])
        held[wanted] = [
            held[wanted][0] - size, held[wanted][1] | source, held[wanted][2] | cluster]


def test_whole_table(spark):
    draw = random.Random(4)
    rows = [
        (i, draw.choice(["hot", "hot", "a", "b", "c", None]), draw.choice([0, 1, 50, 99, 100, 101, 777]),
         draw.choice([None, 1, 2, i, i]), "clash")
        for i in range(600)
    ] + [(None, "a", 30, None, "x"), (None, None, None, None, "x"), (5000, "a", 100_050, 7, "x")] + [
        (7000, "hot", 20, 9, "x")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int, dup long, bin_id string")
    found = pack(docs, F.col("n"), F.col("dup"), capacity=100, shard_documents=150).collect()
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in found:
        total[r.doc_id] += r.n_tokens
        if r.bin_id is None:
            assert r.n_tokens == 0 and r.bin_offset is None
        else:
            bins[r.bin_id].append(r)
    wanted = defaultdict(int)
    for i, _, n, _, _ in rows:
        wanted[i] += n or 0
    assert total == wanted
    by_id = {r[0]: r for r in rows}
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.bin_offset)
        assert sum(r.n_tokens for r in pieces) <= 100
        at = 0
        for r in pieces:
            assert r.bin_offset == at
            at += r.n_tokens
        known = [r for r in pieces if r.doc_id is not None]
        for column in (1, 3):
            keys = [by_id[r.doc_id][column] for r in known if by_id[r.doc_id][column] is not None]
            assert len(keys) == len(set(keys))
    assert pack(docs.limit(0), F.col("n"), F.col("dup")).count() == 0


def test_bins_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    draw = random.Random(6)
    rows = [(draw.choice([None, 1, 2, i]), draw.choice(["a", "b", None]), draw.randint(0, 250),
             draw.choice([None, 1, i])) for i in range(300)] + [(None, "a", 20, 9)] * 200
    kinds = "doc_id long, source string, n int, dup long"
    found = []
    for parts in (1, 5):
        docs = spark.createDataFrame(draw.sample(rows, len(rows)), kinds).repartition(parts)
        found.append(sorted(map(str, pack(docs, F.col("n"), F.col("dup"), 100,
                                          shard_documents=120).collect())))
    assert found[0] == found[1]


def test_sizes_and_clusters(spark):
    docs = spark.createDataFrame(
        [(1, "Ab c"), (2, "aB\nC "), (3, None), (4, " ")], "doc_id long, text string")
    found = docs.select(token_estimate(F.col("text")), copy_cluster(F.col("text"))).collect()
    assert [r[0] for r in found] == [1, 2, 0, 1]
    assert found[0][1] == found[1][1] and found[2][1] is None and found[3][1] is None
