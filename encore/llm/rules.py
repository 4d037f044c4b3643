"""Quality rules: a hashed n-gram logistic regression behind two fixed rules.

Word 1- and 2-grams and character 3- and 4-grams are hashed, each family into rows of its own; a
family counts as shares of its grams. A logistic regression on a bounded sample of labelled
documents gives each row a weight, and Platt's scaling, fitted on a part it was not trained on, turns its
output into a probability. Texts are scored in Arrow batches: all documents of a batch at once, long
ones piece by piece, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import labelled_sample
from encore.session import materialise

FOLDS, HELD_OUT = 5, 0  # rows of this fold are not learned from
# The rules and the thresholds of the verdict.
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30
KEEP, SURE = 0.3, 0.9
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
BITS = 16  # of a row's number within its family
ROWS = 1 << BITS
FAMILIES = ("words", "word pairs", "3 characters", "4 characters")
SAMPLE_ROWS = 6_000  # labelled documents that the regression is fitted on, at most
SCALE = 30.0  # of the shares, so that weights have a fitting size
EPOCHS, BATCH, RATE, PENALTY = 25, 128, 0.05, 1e-6
PIECE = 1 << 19  # characters or words whose grams are held at once
KNOWN_WORDS = 1 << 18
MULTIPLIER = np.uint32(2654435761)


def rows_of(mixed: np.ndarray) -> np.ndarray:
    """Row numbers of 32-bit mixtures."""
    mixed = mixed ^ (mixed >> np.uint32(15))
    return (mixed * MULTIPLIER) >> np.uint32(32 - BITS)


class Words:
    """Hashes of words; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = crc32(word)
        return np.fromiter((known[w] for w in words), np.uint32, len(words))


def grams(text: str, words: list[bytes], hashed: Words) -> Iterator[tuple[int, np.ndarray]]:
    """(family, rows) of a text's grams, in pieces; every gram comes once."""
    for at in range(0, len(words), PIECE):
        found = hashed.hashes(words[at:at + PIECE + 1])
        yield 0, rows_of(found[:PIECE])
        yield 1, rows_of(found[:-1] * np.uint32(0x9E3779B1) + found[1:])
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at:at + PIECE + 3].encode("utf-32-le"), "<u4")
        mixed = np.zeros(len(code), np.uint32)
        for size in (1, 2, 3, 4):
            mixed = mixed[:len(code) - size + 1] * np.uint32(0x85EBCA6B) + code[size - 1:]
            if size > 2:
                yield size - 1, rows_of(mixed[:PIECE])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of words that stands twice or more in the text.

    Windows are named exactly, by doubling: equal pairs of equal names get one name.
    """
    starts = len(words) - window + 1
    if starts < 2:
        return 0
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        pairs = names[:len(names) - step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        reach += step
    twice = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:starts] += twice
    edge[window:] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """Characters in words, symbols, repeated lines, words in repeated windows."""
    blanks = len(data) - len(data.translate(None, BLANKS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEATED_PERCENT * n_words


@dataclass
class Regression:
    """Weights by family and row, and the scaling of the output to a probability."""

    weights: np.ndarray  # families x rows
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str, words: list[bytes], hashed: Words) -> float:
        sums, counts = [0.0] * len(FAMILIES), [0] * len(FAMILIES)
        for family, found in grams(text, words, hashed):
            sums[family] += float(self.weights[family][found].sum(dtype=float))
            counts[family] += len(found)
        return self.bias + SCALE * sum(s / max(n, 1) for s, n in zip(sums, counts, strict=True))

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


Sample = tuple[np.ndarray, np.ndarray, np.ndarray]


def features(text: str | None, hashed: Words) -> Sample:
    """(rows, scaled shares, number of rows of each family) of a text, each row once.

    Two bytes each: a sample of documents is brought together for training.
    """
    text = text or ""
    counts: list[dict] = [{} for _ in FAMILIES]
    for family, found in grams(text, text.encode().split(), hashed):
        for row, count in zip(*map(np.ndarray.tolist, np.unique(found, return_counts=True)), strict=True):
            counts[family][row] = counts[family].get(row, 0) + count
    rows = [np.fromiter(own, "<u2", len(own)) for own in counts]
    shares = [np.fromiter(own.values(), float, len(own)) for own in counts]
    scaled = [(SCALE * s / max(s.sum(), 1)).astype("<f2") for s in shares]
    return np.concatenate(rows), np.concatenate(scaled), np.array([len(r) for r in rows], "<u4")


def train(samples: list[Sample], y: np.ndarray, seed: int = 5) -> Regression:
    """Logistic regression by Adam on nine tenths of the sample, Platt's scaling on the rest."""
    size = len(FAMILIES) * ROWS
    sizes = np.array([len(r) for r, _, _ in samples])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows, shares = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.float16)
    for at, (own, share, families) in zip(starts, samples, strict=False):
        rows[at:at + len(own)] = own
        rows[at:at + len(own)] += np.repeat(np.arange(len(FAMILIES), dtype=np.int32) * ROWS, families)
        shares[at:at + len(own)] = share
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    rest, own = order[:len(y) // 10], order[len(y) // 10:]
    # Rows that occur in the sample, numbered anew: all others keep the weight 0.
    seen = np.zeros(size, bool)
    seen[rows] = True
    used = np.flatnonzero(seen)
    rows = (np.cumsum(seen, dtype=np.int32) - 1)[rows]
    weights, bias = np.zeros(len(used)), 0.0
    first, second, first_b, second_b, step = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0

    def entries(members):
        at = np.concatenate([np.arange(starts[m], starts[m + 1]) for m in members])
        return rows[at], shares[at].astype(float), np.repeat(np.arange(len(members)), sizes[members])

    def margins(members):
        at, share, owner = entries(members)
        return np.bincount(owner, weights[at] * share, len(members)) + bias

    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        shuffled = draw.permutation(own)
        for k in range(0, len(shuffled), BATCH):
            members = shuffled[k:k + BATCH]
            at, share, owner = entries(members)
            out = np.bincount(owner, weights[at] * share, len(members)) + bias
            error = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[members]) / len(members)
            slope = np.bincount(at, share * error[owner], len(used)) + PENALTY * weights
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            first_b, second_b = 0.9 * first_b + 0.1 * error.sum(), 0.999 * second_b + 0.001 * error.sum()**2
            one, two = 1 - 0.9**step, 1 - 0.999**step
            weights -= rate * (first / one) / (np.sqrt(second / two) + 1e-8)
            bias -= rate * (first_b / one) / (np.sqrt(second_b / two) + 1e-8)
    table = np.zeros(size, np.float32)
    table[used] = weights
    found = Regression(table.reshape(len(FAMILIES), ROWS), float(bias))
    if len(rest) >= 50:
        found.slope, found.shift = platt(margins(rest), y[rest])
    return found


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, shift) that make margins into probabilities, by damped Newton steps.

    Targets are drawn in from 0 and 1 by the counts of the classes, so separable rows have an answer.
    """
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(1e-6, float(np.abs(margin).mean()))
    x = np.column_stack([margin / scale, np.ones(len(y))])
    theta = np.array([1.0, 0.0])

    def loss(t):
        z = x @ t
        return float(np.sum(np.logaddexp(0, z) - target * z))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (p - target)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(max(theta[0], 0.0) / scale), float(theta[1])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id",
    text_column: str = "text", limit: int = SAMPLE_ROWS,
) -> Regression:
    """The regression, from at most ``limit`` labelled rows outside the held-out fold.

    Without labels of both classes it gives the share of label 1 in the sample (1 if there are none,
    so that the rules alone decide).
    """

    def hashed(batches):
        known = Words()
        for batch in batches:
            found = [features(text, known) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([own[k].tobytes() for own in found], pa.binary())
                                    for k in range(3)]],
                names=["label", "grams", "shares", "sizes"])

    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, id_column, text_column, limit)
    stored = materialise(sample.mapInArrow(
        hashed, "label int, grams binary, shares binary, sizes binary"), "grams")
    known = sorted(tuple(row) for row in stored.toLocalIterator())  # the same in any order
    y = np.array([row[0] > 0 for row in known], float)
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 1.0
        constant = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
        return Regression(np.zeros((len(FAMILIES), ROWS), np.float32), constant)
    return train([tuple(np.frombuffer(row[k + 1], kind) for k, kind in enumerate(("<u2", "<f2", "<u4")))
                  for row in known], y)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``kept``, ``score``, ``verdict``.

    ``kept`` is false if the base rules fail, else whether the score reaches 0.3; ``verdict`` is
    ``rule``, ``drop``, ``doubtful`` (below 0.9) or ``keep``. Words are runs without ASCII blanks. Null and
    empty texts have no words and fail; null ids stay null, repeated rows are judged each, other columns
    are not read, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        fit(docs, labels, id_column=id_column, text_column=text_column))

    def judge(batches):
        hashed, regression = Words(), model.value
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                data = text.encode()
                words = data.split()
                counts = base_counts(text, data, words)
                score = regression.probability(regression.margin(text, words, hashed))
                found.append((len(words), *counts, base_failed(len(words), counts[3]), score))
            *counts, failed, score = zip(*found, strict=True) if found else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(failed, pa.bool_()), pa.array(score, pa.float64())],
                names=["id", *COLUMNS, "base_failed", "score"])

    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    judged = read.mapInArrow(judge, f"id {kind}, " + ", ".join(
        f"{name} long" for name in COLUMNS) + ", base_failed boolean, score double")
    verdict = F.when(F.col("base_failed"), "rule").when(F.col("score") < KEEP, "drop").when(
        F.col("score") < SURE, "doubtful").otherwise("keep")
    return judged.select(
        F.col("id").alias(id_column), *COLUMNS, "base_failed",
        (~F.col("base_failed") & (F.col("score") >= KEEP)).alias("kept"), "score",
        verdict.alias("verdict"))
