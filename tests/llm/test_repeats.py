import gc
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from encore.llm import repeats
from encore.llm import suffix_array as suffix_array_module
from encore.llm.repeats import LAST, remove_repeats, repeat_report
from encore.llm.suffix_array import common_prefixes, suffix_array


def test_names_are_sorted_recursively(monkeypatch):
    """Against sorting all suffixes, with batches of every size and long chains of names."""
    draw = np.random.default_rng(9)
    for batch, chain in ((8192, 8), (4, 2), (1, 3), (16, 2)):
        monkeypatch.setattr(suffix_array_module, "BATCH", batch)
        monkeypatch.setattr(suffix_array_module, "CHAIN", chain)
        for k in range(150):
            names = draw.integers(0, draw.integers(1, 60) + 1, draw.integers(2, 120))
            if k % 3 == 0:  # periods
                names = np.tile(names[:max(1, len(names) // 6)], 6)
            elif k % 3 == 1:  # long descents
                names = np.tile(np.sort(names)[::-1], 2)
            names = np.unique(names, return_inverse=True)[1]
            plain = names.tolist()
            wanted = sorted(range(len(plain)), key=lambda i: plain[i:])
            assert suffix_array_module.order_of_names(names).tolist() == wanted


def test_suffix_array_and_prefixes():
    draw = random.Random(7)
    for _ in range(400):
        letters = draw.choice([b"ab", b"a", b"abc", bytes(range(256))])
        data = bytes(draw.choice(letters) for _ in range(draw.randint(1, 70)))
        text = np.frombuffer(data, np.uint8)
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = common_prefixes(text, sa, np.array([0]), 100)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            n = 0
            while max(i, j) + n < len(data) and data[i + n] == data[j + n]:
                n += 1
            assert shared[i] == n


def plain(rows, length):
    """(doc, text) -> (bytes, removed, spans, hash of the rest)."""
    distinct = sorted({(LAST if i is None else i, t or "") for i, t in rows})
    # Rows without an id follow the hash of their text; the cases have one text without an id.
    seen, found = set(), {}
    for doc, text in distinct:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            piece = data[s:s + length]
            if piece in seen:
                gone[s:s + length] = True
            seen.add(piece)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        found[doc, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return found


def case(seed, length):
    draw = random.Random(seed)
    letters = "ab é日c "
    some = lambda n: "".join(draw.choice(letters) for _ in range(n))
    passages = [some(draw.choice([length // 2, length, 3 * length])) for _ in range(6)]
    rows = []
    for i in range(120):
        text = some(draw.choice([0, 5, length, 4 * length]))
        for _ in range(draw.choice([0, 1, 3])):
            text += draw.choice(passages) + some(draw.choice([0, 3, length]))
        rows.append((draw.randrange(10**6), text))
    long_text = some(length * 40)
    rows += [(i, long_text) for i in (5, 3, 9)] + [(77, long_text[:-7] + "x"), (78, "a" * 30 * length),
                                                   (79, "ab" * 10 * length)]
    rows += [(2_000_000, None), (2_000_001, ""), (None, passages[5] * 3), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("length,gram,runs", [(20, 8, 8192), (24, 4, 6), (100, 32, 8192), (100, 32, 10)])
def test_against_brute_force(spark, monkeypatch, length, gram, runs):
    monkeypatch.setattr(repeats, "SHARD_RUNS", runs)  # small: many shards, minimizers split
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 10_000)
    rows = case(length + runs, length)
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, low int",
    ).repartition(5)
    found = sorted(map(tuple, repeat_report(docs, length, gram).collect()), key=str)
    expected = plain(rows, length)
    wanted = [(i, *expected[LAST if i is None else i, t or ""][:4]) for i, t in rows]
    assert found == sorted(wanted, key=str)
    assert sum(r[2] for r in found) > 40 * length
    kept = remove_repeats(docs, length, gram)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted((str(i), expected[LAST if i is None else i, t or ""][4].decode(errors="ignore"))
                         for i, t in rows)


def unique_stretch(draw, period, size):
    word = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=period))
    return (word * size)[:size]


@pytest.mark.parametrize("bucket_bytes", [10_000, 16 << 20])
def test_stretches_that_repeat_only_in_themselves(spark, monkeypatch, bucket_bytes):
    """Of a period that is nowhere else: one run of starts each, often with a minimizer of its own."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket_bytes)
    draw = random.Random(3)
    other = lambda n: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ ", k=n))
    rows = [(0, "a" * 150)]
    for size in range(101, 169):
        period = draw.randint(1, 60)
        rows.append((len(rows), unique_stretch(draw, period, size)))
        rows.append((len(rows), other(draw.randint(1, 400)) + unique_stretch(draw, period, size)
                     + other(draw.randint(1, 400))))
    rows += [(5000, rows[6][1]), (5001, rows[6][1] + other(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(map(tuple, repeat_report(docs).collect()))
    expected = plain(rows, 100)
    assert found == sorted((i, *expected[i, t][:4]) for i, t in rows)
    assert next(r[2] for r in found if r[0] == 0) == 149
    kept = {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    assert kept == {i: expected[i, t][4].decode() for i, t in rows}


def test_one_document_of_one_passage_is_spread(spark, monkeypatch):
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(draw.choices(letters, k=200))
    text = "".join(passage + "".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(1500))
    rows = [(1, text), (2, passage + "x"), (3, "y" + passage)]
    bound = 100
    whole = repeats.shard_repeats

    def bounded(length):
        def find(table):
            if table.num_rows > 5 * bound:  # shards are hashed, so some hold more than the mean
                raise ValueError(f"{table.num_rows} stretches in a shard")
            return whole(length)(table)
        return find

    monkeypatch.setattr(repeats, "SHARD_RUNS", bound)
    monkeypatch.setattr(repeats, "shard_repeats", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(rows, 100)
    assert sorted(map(tuple, repeat_report(docs).collect())) == [
        (i, *expected[i, t][:4]) for i, t in rows]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert repeat_report(docs.limit(0)).count() == 0
    assert [r.n_removed for r in repeat_report(docs).collect()] == [0]
    assert remove_repeats(docs).collect() == docs.collect()


def test_a_shard_takes_few_times_its_text():
    """Arrays of 32-bit places and no Python row per range: memory and output of a shard."""
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(300)]
    some = lambda n: " ".join(draw.choices(words, k=n)).encode()
    shared = [some(40) for _ in range(50)]
    stretches = [some(10) + draw.choice(shared) + some(10) for _ in range(2000)]
    stretches += stretches[:500]
    n = len(stretches)
    table = pa.table({
        "shard": pa.array([0] * n), "split": pa.array([i % 2 == 0 for i in range(n)]),
        "doc": pa.array(range(n)), "content": pa.array(range(n)), "start": pa.array([7] * n, pa.int32()),
        "stretch": pa.array(stretches, pa.binary())})
    size = sum(map(len, stretches[:2000])) + 2000
    tracemalloc.start()
    found = repeats.shard_repeats(100)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 125 * size
    assert found.filter(pa.array(np.array(found["left"].is_null()))).num_rows >= 500 + 1900


def test_stretches_of_a_sliced_batch():
    texts = ["0123456789" * 3, "é" + "abcdefghij" * 3, "x" * 40]
    runs = [[{"start": 2, "run": 3, "shard": 5, "split": True}],
            [{"start": i, "run": 1, "shard": i, "split": False} for i in range(7)],
            [{"start": 0, "run": 30, "shard": 1, "split": True}]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("run", pa.int32()), ("shard", pa.int64()),
                               ("split", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array(texts), pa.array(runs, kind)],
        names=["doc", "content", "whole", "found"])
    rows = [r for b in repeats.cut_stretches(iter([batch.slice(1)]), 10) for r in b.to_pylist()]
    assert [(r["doc"], r["content"], r["shard"], r["start"], r["split"]) for r in rows] == [
        *((2, 5, i, i, False) for i in range(7)), (3, 6, 1, 0, True)]
    assert [r["stretch"] for r in rows] == [texts[1].encode()[i:i + 10] for i in range(7)] + [b"x" * 39]


def test_sorting_keeps_no_arrays():
    """Only the suffix array is left afterwards, also before the garbage collector comes."""
    draw = random.Random(12)
    text = np.frombuffer("".join(draw.choices("abcdefgh ", k=100_000)).encode(), np.uint8)
    suffix_array(text[:1000])
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        sa = suffix_array(text)
        left = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert sa.nbytes <= left < 2 * sa.nbytes
