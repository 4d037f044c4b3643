import random
import sys
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest

from encore.llm import conversations, queries
from encore.llm.common import table

sys.setrecursionlimit(20_000)  # of the brute force
SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    digest = lambda r: sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), digest(r)))


def plain(rows):
    """The report of one conversation, straight from its definition."""
    rows = damage(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(BLANKS)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen
                      else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, put_in):
        """(cost, audit, output) from here, by trying all edits."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        fill = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[fill]
        if put_in < 3:
            cost, audit, out = best(i, fill, put_in + 1)
            ways.append((cost + 3, "I" + audit, ((name, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                cost, audit, out = best(i + 1, fill, 0)
                ways.append((cost + 3 + extra, "R" + audit, ((name, text), *out)))
                if (state, role[:1]) in follow:
                    cost, audit, out = best(i + 1, follow[state, role[:1]], 0)
                    ways.append((cost + extra, "K" + audit, ((role, text), *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    text = "\n".join(f"{role}:{text}" for role, text in out)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal,
            cost, audit, sha256(text.encode()).hexdigest()), list(out)


def compare(spark, rows, block=conversations.BLOCK):
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: tuple(r)[1:] for r in conversations.repair_report(df, block=block).collect()}
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    assert found.keys() == by.keys()
    for conv, own in by.items():
        assert found[conv] == plain(own)[0], conv
    return df, by


def drawn(seed, conversations, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "a", "US"]
    texts = ["Yes.", "No!", "Yes.", "open ended", "", " \n", None, "ü?", "so. \t", "same"]
    return [(conv, draw.choice([t, t, t, t // 2, None]), draw.choice(roles[:3] * 4 + roles),
             draw.choice(texts + [f"{draw.random()}."] * 9))
            for conv in range(conversations) for t in range(draw.randint(0, longest))]


def test_equals_brute_force(spark):
    df, by = compare(spark, drawn(1, 400, 9) + [(None, t, "user", "Hm.") for t in range(5)])
    turns = conversations.repaired_turns(df).collect()
    for conv, own in by.items():
        rows = sorted((r.at, r.role, r.text) for r in turns if r.conv_id == conv)
        assert rows == [(i, *row) for i, row in enumerate(plain(own)[1])]


@pytest.mark.parametrize("size", [1, 5])
def test_blocks_give_the_same(spark, size):
    compare(spark, drawn(2, 12, 40), size)


def test_crossing_blocks_and_random_codes():
    draw = random.Random(3)
    for _ in range(300):
        codes = bytes(draw.choice(range(9)) for _ in range(draw.randint(0, 14)))
        letters, cost = conversations.solved(codes)
        cut = draw.randint(0, len(codes))
        one, two = conversations.crossings(codes[:cut], False), conversations.crossings(codes[cut:], True)
        assert cost == min(one[s] + two[4 * s] for s in range(4))
        assert sum(c != "I" for c in letters) == len(codes)


def test_odd_tables(spark):
    long = ("word " * 50_000 + ".")
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", long) for t in range(6)]
    rows += [(2, None, None, None)] * 3 + [(None, None, "user", "a.")] * 2 + [(3, 2**62, "assistant", "b.")]
    compare(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumnsRenamed({"conv_id": "id"}).selectExpr(
        "id as conv", "turn", "role", "text", "1 as weight", "2 as at", "3 as block", "4 as digest")
    assert conversations.repair_report(extra, "conv").count() == 4
    assert conversations.repair_report(df.limit(0)).count() == 0


def test_a_conversation_without_rows(spark):
    turn = next(t for t in range(100) if crc32(f"5:{t}".encode()) % 20 == 0)
    row = conversations.repair_report(spark.createDataFrame([(5, turn, "user", "Hm.")], SCHEMA)).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t % 200}.") for t in range(400)]
    compare(spark, rows)  # several blocks of the usual size


@pytest.mark.parametrize("sf_dir", [SF_DIR])
def test_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, sf_dir).collect()}
    for conv in {r[0] for r in rows}:
        assert found[conv] == plain([r for r in rows if r[0] == conv])[0]
