"""Document quality from random-indexing word vectors and a small neural network.

Every token has a random index vector: that of its word plus that of its shape. A word's vector is the
sum of the index vectors around it over the whole corpus; words are hashed into a fixed number of rows,
so the table has a fixed size whatever the corpus. A document is the mean of its tokens' word vectors
and of their index vectors. A two-layer network is trained on a bounded sample of labelled documents,
and its probabilities are calibrated by a temperature fitted on a part it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import labelled_sample, with_scores
from encore.session import materialise

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
ROWS, WORD_VECTORS, SHAPES, DIMENSION = 4096, 512, 64, 64
SLICES = 16  # of the table, when tasks' sums are added
FAN_IN = 4096  # of the first round of adding
REACH = 2  # tokens to either side
HIDDEN, EPOCHS, PENALTY = 32, 80, 1e-3
CACHED_TOKENS = 1 << 18
PART_TOKENS = 1 << 17  # handled at a time
SAME = SHAPES - 1  # shape that stands for a neighbour equal to the word itself


def index_vectors(count: int, seed: int) -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, the same wherever they are made."""
    draw = np.random.default_rng(seed)
    table = np.zeros((count, DIMENSION), np.float32)
    for row in table:
        row[draw.choice(DIMENSION, 8, replace=False)] = draw.choice([-1, 1], 8)
    return table


WORD_INDEX, SHAPE_INDEX = index_vectors(WORD_VECTORS, 1), index_vectors(SHAPES, 2)


def shape(token: str) -> int:
    """Case, kind of the last characters, and whether the token is long; below SAME."""
    letters = token.rstrip("!?.,;:#$%&*|-_=+~")
    tail = token[len(letters):]
    case = 0 if not letters else (
        1 if letters.islower() else 2 if letters.isupper() else 3 if letters.istitle() else 4)
    ends = 0 if not tail else 1 if tail in ".,;:?" else 2 if tail[0] in "!?" else 3
    return 15 * (not letters.isalpha()) + 3 * case + min(ends, 2) + 30 * (ends == 3 or len(token) > 30)


class Tokens:
    """Rows, index words and shapes of tokens; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def pack(self, token: str) -> int:
        code = crc32(token.encode())
        packed = (code % ROWS << 32) | (code // ROWS % WORD_VECTORS << 16) | shape(token)
        if len(self.known) >= CACHED_TOKENS:
            self.known.clear()
        self.known[token] = packed
        return packed

    def of(self, text: str | None) -> np.ndarray:
        known = self.known.get
        tokens = (text or "").split()
        return np.fromiter(
            (known(t) or self.pack(t) for t in tokens), np.int64, len(tokens))


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 32, packed >> 16 & 0xFFFF, packed & 0xFFFF


def parts(packed: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(packed), PART_TOKENS):
        yield packed[at:at + PART_TOKENS]


class Contexts:
    """Counts of (row, index word) and (row, shape) around tokens, turned into sums at the end."""

    def __init__(self):
        self.words = np.zeros(ROWS * WORD_VECTORS, np.int64)
        self.shapes = np.zeros(ROWS * SHAPES, np.int64)
        self.waiting: list[np.ndarray] = []
        self.count = 0

    def add(self, packed: np.ndarray) -> None:
        """One document; the gap to the next is wider than the reach."""
        self.waiting += [packed, np.full(REACH, -1, np.int64)]
        self.count += len(packed) + REACH
        if self.count >= PART_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        packed = np.concatenate(self.waiting)
        self.waiting, self.count = [], 0
        row, word, form = unpack(packed)
        for step in range(1, REACH + 1):
            inside = (packed[:-step] >= 0) & (packed[step:] >= 0)
            same = packed[:-step] == packed[step:]
            for a, b in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                at = row[a][inside]
                near = np.where(same, SAME, form[b])[inside]
                self.words += np.bincount(
                    at * WORD_VECTORS + word[b][inside], minlength=len(self.words))
                self.shapes += np.bincount(at * SHAPES + near, minlength=len(self.shapes))

    def sums(self) -> np.ndarray:
        self.flush()
        return (self.words.reshape(ROWS, -1) @ WORD_INDEX.astype(float)
                + self.shapes.reshape(ROWS, -1) @ SHAPE_INDEX.astype(float))


def word_vectors(docs: DataFrame, text_column: str) -> np.ndarray:
    """The table of word vectors over all documents, of unit length.

    Tasks' tables are added slice by slice, a bounded number at a time in two rounds.
    """
    size = ROWS // SLICES

    def count(batches):
        contexts, tokens = Contexts(), Tokens()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                contexts.add(tokens.of(text))
        table = contexts.sums().astype("<f8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()),
             pa.array([table[k * size:(k + 1) * size].tobytes() for k in range(SLICES)])],
            names=["slice", "vectors"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in table.column("vectors").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "vectors": pa.array([total.tobytes()])})

    schema = "slice int, vectors binary"
    sums = docs.select(text_column).mapInArrow(count, schema).groupBy(
        "slice", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).applyInArrow(add, schema)
    slices = sums.groupBy("slice").applyInArrow(add, schema).collect()  # the table: 2 MB
    table = np.zeros((ROWS, DIMENSION))
    for row in slices:
        table[row.slice * size:(row.slice + 1) * size] = np.frombuffer(row.vectors).reshape(size, -1)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(packed: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means of word vectors and of index vectors, the share of repeats, and the length."""
    total = np.zeros(2 * DIMENSION)
    for part in parts(packed):
        row, word, form = unpack(part)
        counts = np.bincount(form, minlength=SHAPES).astype(np.float32)
        total[:DIMENSION] += vectors[row].sum(axis=0)
        total[DIMENSION:] += counts @ SHAPE_INDEX + (
            np.bincount(word, minlength=WORD_VECTORS).astype(np.float32) @ WORD_INDEX)
    n = len(packed)
    same = np.count_nonzero(packed[1:] == packed[:-1])
    return np.append(total / max(n, 1), [4 * same / max(n, 1), np.log1p(n) / 8])


@dataclass
class Network:
    """Two layers, with the scaling of their inputs and the temperature of their output."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Train on nine tenths, fit the temperature on the rest."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(x))
    rest, own = order[:len(x) // 10], order[len(x) // 10:]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    net = Network(mean, scale, draw.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]),
                  np.zeros(HIDDEN), draw.standard_normal(HIDDEN) / np.sqrt(HIDDEN), 0.0)
    z = (x - mean) / scale
    weights = [net.first, net.first_bias, net.second, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        shuffled = draw.permutation(own)
        for at in range(0, len(shuffled), 256):
            batch = shuffled[at:at + 256]
            hidden = np.tanh(z[batch] @ weights[0] + weights[1])
            out = hidden @ weights[2] + weights[3][0]
            error = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[batch]) / len(batch)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [z[batch].T @ back + PENALTY * weights[0], back.sum(axis=0),
                      hidden.T @ error + PENALTY * weights[2], np.array([error.sum()])]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                weights[k] = weights[k] - rate * first[k] / (1 - 0.9**step) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.first, net.first_bias, net.second = weights[:3]
    net.second_bias = float(weights[3][0])
    if len(rest) >= 50:
        logits, grid = net.logits(x[rest]), np.geomspace(0.25, 8, 60)
        net.temperature = float(min(grid, key=lambda t: loss(logits / t, y[rest])))
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network | None
    constant: float = 0.5

    def scores(self, texts: list[str | None], tokens: Tokens) -> list[float]:
        if self.network is None:
            return [self.constant] * len(texts)
        found = np.array([pooled(tokens.of(text), self.vectors) for text in texts])
        return self.network.probabilities(found).tolist() if len(texts) else []


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id",
    text_column: str = "text",
) -> Classifier:
    """Word vectors over all documents, then the network on the labelled sample.

    Without labels of both classes every score is the share of label 1 in the sample (0.5 if empty).
    """
    vectors = word_vectors(docs, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        tokens = Tokens()
        for batch in batches:
            found = [pooled(tokens.of(t), shared.value).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary())], names=["label", "pooled"])

    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, id_column, text_column)
    known = materialise(sample.mapInArrow(pool, "label int, pooled binary"), "pooled").collect()
    y = np.array([row.label > 0 for row in known], float)
    if not 0 < y.sum() < len(y):
        return Classifier(vectors, None, float(y.mean()) if len(y) else 0.5)
    # Rows come back in any order; a fixed one makes the fit repeatable.
    x = np.array([np.frombuffer(row.pooled) for row in known])
    order = np.lexsort(x.T[:8])
    return Classifier(vectors, train(x[order], y[order]))


def shared_scores(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str):
    shared = docs.sparkSession.sparkContext.broadcast(
        fit(docs, labels, id_column=id_column, text_column=text_column))

    def scores(batches):
        tokens = Tokens()
        for texts in batches:
            yield shared.value.scores(texts, tokens)

    return scores


def quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` (score of 0.3 or more).

    Texts alone decide the score; null and empty ones score as a document without tokens. Null ids
    stay null and are not held out, repeated rows are scored each, other columns are not read.
    """
    scores = shared_scores(docs, labels, id_column, text_column)
    return with_scores(docs, scores, FOLDS, HELD_OUT, THRESHOLD, id_column, text_column)


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns, whatever their names.

    Null and empty texts score as a document without tokens, null ids are scored like others,
    repeated rows stay or go together. An empty table gives no rows; without labels of both classes
    all rows have one score.
    """
    scores = shared_scores(docs, labels, id_column, text_column)
    at = docs.columns.index(text_column)

    def keep(batches):
        waiting = []

        def texts():
            for batch in batches:
                waiting.append(batch)
                yield batch.column(at).to_pylist()

        for values in scores(texts()):
            yield waiting.pop(0).filter(pa.array([v >= threshold for v in values], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
