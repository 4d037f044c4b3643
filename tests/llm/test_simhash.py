import random

import numpy as np
import xxhash

from encore.llm import simhash


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, threshold):
    ids = [i for i, _ in rows if i is not None]
    prints = {}
    for i, text in rows:
        prints.setdefault(plain_fingerprint(text), []).append(i)
    keys = list(prints)
    label = {k: k for k in keys}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for x in keys:
        for y in keys:
            if (x ^ y).bit_count() <= threshold:
                label[top(x)] = top(y)
    groups = {}
    for k in keys:
        groups.setdefault(top(k), []).extend(i for i in prints[k] if i is not None)
    assert ids
    return {k: min(groups[top(k)], default=None) for k in keys}


def test_code_is_perfect():
    assert (simhash.leaders() >= 0).all()
    assert len(simhash.light_words(3)) == 1 << simhash.CHECKS


def test_pairs_within_the_threshold_meet():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 300, dtype=np.int64)
    flips = [
        np.bitwise_xor.reduce([np.int64(1) << int(b) for b in draw.choice(63, n, replace=False)])
        for n in draw.integers(1, 3, 300)
    ]
    other = base ^ np.array(flips)
    homes = simhash.home_anchors(base)
    row, anchors = simhash.visited_anchors(other, 2)
    met = {(r, a) for r, a in zip(row.tolist(), anchors.tolist(), strict=True)}
    assert all((i, h) in met for i, h in enumerate(homes.tolist()))
    assert len(row) / len(other) < 70


def test_against_brute_force(spark):
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (None, "one"), (None, "no one has this id")]
    for i in range(10, 60):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([2, 30, 300]))]
        rows.append((i, " ".join(words)))
        for j in range(draw.choice([0, 1, 4])):
            copy = list(words)
            copy[draw.randrange(len(copy))] = "changed"
            rows.append((100 * i + j, "  ".join(copy)))
    rows += [(77777, "word " * 30_000), (77778, "word " * 30_001), rows[12], rows[12]]
    docs = spark.createDataFrame(
        [(i, t, "x", i) for i, t in rows], "doc_id long, text string, print string, component long")
    found = simhash.near_duplicates(docs).collect()
    component = plain_components(rows, 2)
    wanted = [
        (i, f"{plain_fingerprint(t):016x}", component[plain_fingerprint(t)]) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert len({r.component_id for r in found}) < len({r.fingerprint for r in found})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chain_of_links(spark):
    from encore.llm.components import components

    chain = [(i, i + 1) for i in range(0, 40)] + [(90, 91), (91, 91), (91, 90), (None, 3)]
    links = spark.createDataFrame(chain, "a long, b long")
    found = dict(map(tuple, components(links).collect()))
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}
