import hashlib
import random
import re

import pytest

from encore.llm.decontaminate import contamination, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=13):
    listed = [(i, plain_words(t)) for i, t in items]
    found = []
    for doc_id, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for item_id, item in listed:
            size = min(window, len(item))
            windows = {tuple(item[i:i + size]) for i in range(len(item) - size + 1)} if size else ()
            for i in range(len(words) - size + 1) if size else ():
                if tuple(words[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    ids.add("null" if item_id is None else str(item_id))
        joined = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        found.append((doc_id, len(words), len(hit), len(ids), joined,
                      len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(found, key=str)


def case(seed, short):
    draw = random.Random(seed)
    pool = ["the", "The", "a", "é", "of", "x1", "日本"] + [f"w{i}" for i in range(30)]
    some = lambda n: [draw.choice(pool) for _ in range(n)]
    passage = some(40)
    items = [(i, some(draw.randint(13, 60))) for i in range(8)]
    items += [(20, passage), (21, some(5) + passage[3:30]), (22, passage), (23, ["the"] * 20)]
    items += [(100 + i, some(draw.choice([1, 3, 7, 12]))) for i in range(4)] if short else []
    docs = []
    for i in range(60):
        words = some(draw.choice([0, 5, 12, 13, 100, 400]))
        for _ in range(draw.choice([0, 1, 3])):
            _, item = draw.choice(items)
            a = draw.randrange(len(item))
            at = draw.randint(0, len(words))
            words[at:at] = item[a:a + draw.choice([8, 12, 13, 14, 60])]
        docs.append((i, draw.choice([" ", ", ", "\n", "\x00", "\x7f_"]).join(words)))
    docs += [(900, None), (901, ""), (902, " ,;"), (903, "the " * 300), (904, " ".join(passage)),
             (905, " ".join(passage)), (None, " ".join(passage)), (904, " ".join(passage))]
    items = [(i, " ".join(w)) for i, w in items] + [
        (50, None), (51, ""), (52, "..."), (20, " ".join(passage)), (None, " ".join(passage))]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, short):
    docs, items = case(1 + short, short)
    frame = spark.createDataFrame(
        [(i, t, "k", 1) for i, t in docs], "doc_id long, text string, contaminated_key string, n_words int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, hash int")
    found = sorted(map(tuple, contamination(frame, bench).collect()), key=str)
    assert found == plain(docs, items)
    assert sum(row[5] for row in found) > 10
    clean = remove_contaminated(frame, bench)
    assert clean.columns == frame.columns
    bad = {(row[0], row[1]) for row in found if row[5]}
    wanted = [(i, t) for i, t in docs if (i, len(plain_words(t))) not in bad]
    assert sorted((r.doc_id, r.text) for r in clean.collect() if r.doc_id is not None) == sorted(
        ((i, t) for i, t in wanted if i is not None), key=lambda r: (r[0], r[1] or ""))


def test_empty(spark):
    docs, items = case(3, False)
    frame = spark.createDataFrame(docs[-8:], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(frame.limit(0), bench).count() == 0
    assert {r.n_items for r in contamination(frame, bench.limit(0)).collect()} == {0}


def test_segments_lose_no_window(spark, monkeypatch):
    from encore.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SEGMENT", 40)
    docs, items = case(5, True)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(map(tuple, contamination(frame, bench).collect()), key=str)
    assert found == plain(docs, items)
