import random
import re

from encore.llm import license_scan
from encore.llm.license_scan import BASE, LEAST_MATCH, NOTICES, Template, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    at = [
        (i, t.label) for t in BASE for i in range(len(words))
        if words[i:i + len(t.text.split())] == t.text.split()
    ]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in at})))


def test_base_places_against_brute_force(spark):
    draw = random.Random(6)
    pool = "cc by general public license all rights reserved CC-BY Général ,cc;by é the".split(" ")
    texts = [None, "", "cc", "cc by cc by", "CC\nBY", "ccby", "by cc" * 1000] + [
        " ".join(draw.choice(pool) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(3, "cc by", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    found = sorted((tuple(r)[:6] for r in scan_licenses(docs).collect()), key=str)
    assert found == sorted(((i, *plain_scan(t)) for i, t, _ in rows), key=str)
    assert scan_licenses(docs.limit(0)).count() == 0


def test_notices(spark):
    texts = {
        "Released under the MIT License.": "mit",
        "x y Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "under the GNU Lesser General Public License": "gpl,lgpl",
        "a mit b license": "", "licensed under the sun": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [found[i].labels for i in range(len(texts))] == list(texts.values())
    assert all((r.score > 0) == bool(r.labels) and 0 <= r.score <= 1 for r in found.values())


def in_order(template, words, start, shift):
    """Longest common subsequence with places at most ``shift`` apart, by the whole table."""
    best = {}
    for i in range(len(template)):
        for j in range(len(words)):
            best[i, j] = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0))
            if template[i] == words[j] and abs(j - start - i) <= shift:
                best[i, j] = max(best[i, j], best.get((i - 1, j - 1), 0) + 1)
    return best[len(template) - 1, len(words) - 1] if words else 0


def plain_notices(text, templates):
    """Labels and score by trying each template at each start."""
    words = license_scan.words_of(text)
    labels, score = set(), 0.0
    for t in templates:
        template = license_scan.words_of(t.text)
        n = len(template)
        shift = 0 if t.base else min(license_scan.MOST_SHIFT, n // license_scan.WORDS_PER_SHIFT)
        for start in range(-n, len(words) + n):
            keyed = all(
                any(words[j:j + len(key)] == key and template[p:p + len(key)] == key
                    for p in range(n) for j in range(max(0, start + p - shift), start + p + shift + 1))
                for key in map(license_scan.words_of, t.keys))
            share = in_order(template, words, start, shift) / n if keyed else 0.0
            if share >= (1.0 if t.base else LEAST_MATCH):
                labels.add(t.label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_and_scores_against_brute_force(spark):
    draw = random.Random(16)
    templates = BASE + (
        Template("x", "a b c d e f", ("b c",)),
        Template("long", "use of the work is free to all who keep this note in each copy they make or "
                 "hand on to others", ("work is free",)),
        Template("two", "a b"))
    long_words = templates[-2].text.split()
    pool = ["a", "b", "c", "d", "e", "f", "cc", "by", "work", "is", "free", "note"]
    texts = [None, "", "a", "b c"]
    for _ in range(200):
        words = [draw.choice(pool) for _ in range(draw.randint(0, 12))]
        if draw.random() < 0.6:
            notice = list(draw.choice([long_words, "a b c d e f".split(), "cc by".split()]))
            for _ in range(draw.randint(0, 9)):
                at = draw.randrange(len(notice))
                kind = draw.random()
                if kind < 0.5:
                    notice[at] = draw.choice(pool)
                elif kind < 0.75:
                    notice.insert(at, draw.choice(pool))
                elif len(notice) > 1:
                    del notice[at]
            words[draw.randint(0, len(words)):0] = notice
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs, templates).collect()}
    wanted = {i: plain_notices(text, templates) for i, text in enumerate(texts)}
    assert found == wanted
    assert sum("long" in labels for labels, _ in wanted.values()) > 10


def test_changed_and_missing_words():
    index = license_scan.Index(BASE + NOTICES, {})
    for notice in (t for t in NOTICES if len(t.text.split()) >= 40):
        words, keys = notice.text.split(), " ".join(notice.keys).split()
        free = [i for i, word in enumerate(words) if word not in keys]
        for damage in ("changed", "missing", "more"):
            text = list(words)
            if damage == "changed":
                for i in free[::6]:
                    text[i] = "zzz"
            elif damage == "missing":
                del text[free[len(free) // 2]]
            else:
                text.insert(free[0], "zzz")
            labels = index.scan("intro " + " ".join(text) + " end")[5].split(",")
            assert notice.label in labels, (notice.label, damage)
        assert notice.label not in index.scan(" ".join(words[:len(words) // 2]))[5].split(",") or any(
            t.label == notice.label and t is not notice for t in NOTICES)


def test_starts_need_two_places():
    index = license_scan.Index(NOTICES, {})
    assert not any(index.starts(license_scan.words_of("mit " * 1000)).values())
    assert index.scan("charge obtaining hereby granted " * 500)[5] == ""
