"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are shares of a lexicon (words and beginnings of words that a bounded sample of labelled
documents shows to be telling) and hand-written patterns. Each votes for toxic or abstains. The label
model is fitted to the votes on all documents by expectation maximisation: for either class it has the
rate at which each voter fires (its accuracy), and for the toxic one the voters' correlations, so that
voters that echo each other do not count twice. Its posterior labels the sample
on which the linear classifier over all lexicon entries is trained.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import WORD_BYTES, labelled_sample, rows, with_scores
from encore.session import materialise

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
CANDIDATES, ENTRIES = 4000, 512  # entries looked at, and taken into the lexicon
CHARGE, FADE, LEAST_GAIN = 2.0, 0.8, 2.0  # see choose()
LEAST_DOCUMENTS = 4  # toxic ones that an entry is in
LEAST_ODDS, LEAST_EVIDENCE = 2.5, 3.0  # an entry's log odds ratio, also in standard errors
ANCHOR = 1.0  # weight of the labelled sample's moments, as a multiple of the corpus
STEMS = (4, 5, 6, 7)  # bytes of the beginnings of words
WORD_VOTERS, STEM_VOTERS = 16, 12
ROUNDS = 8  # of expectation maximisation
UPPERS = bytes(range(65, 91))


def exclaims(data: bytes) -> bool:
    return data.count(b"!!") >= 3


def shouts(data: bytes) -> bool:
    return 3 * (len(data) - len(data.translate(None, UPPERS))) > len(data) > 20


def masks_letters(data: bytes) -> bool:
    return re.search(rb"[A-Za-z][*#$@]{2,}[A-Za-z]", data) is not None


def addresses(data: bytes) -> bool:
    return re.search(rb"(?i)\byou(?:'re| are) (?:a|an|such)\b", data) is not None


PATTERNS = (exclaims, shouts, masks_letters, addresses)


def entries_of(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words (marked by a blank before them)."""
    found = set(words)
    for size in STEMS:
        found.update(b" " + w[:size] for w in words if len(w) > size)
    return found


def mine_lexicon(sample: DataFrame, limit: int) -> list[bytes]:
    """The entries of most evidence for the label, from (label, text) rows."""

    def count(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for label, text in rows(batches):
            n[label > 0] += 1
            (toxic if label > 0 else clean).update(entries_of(words_in(text)))
        toxic[b""], clean[b""] = n[1], n[0]
        every = list(toxic.keys() | clean.keys())
        for a in range(0, len(every), 50_000):
            part = every[a:a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([toxic[e] for e in part], pa.int64()),
                 pa.array([clean[e] for e in part], pa.int64())], names=["entry", "toxic", "clean"])

    counts = materialise(
        sample.mapInArrow(count, "entry binary, toxic long, clean long").groupBy("entry").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
        ).filter((F.col("toxic") >= LEAST_DOCUMENTS) | (F.length("entry") == 0)), "lexicon-counts")
    total = counts.filter(F.length("entry") == 0).first()
    if total is None:
        return []
    p, n = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(p / (total.toxic + 1 - p)) - F.log(n / (total.clean + 1 - n))
    evidence = odds / F.sqrt(1 / p + 1 / n)
    telling = (odds > LEAST_ODDS) & (evidence > LEAST_EVIDENCE)
    likely = counts.filter((F.length("entry") > 0) & telling).orderBy(
        evidence.desc(), "entry").limit(CANDIDATES).select("entry").collect()
    likely = Voters([bytes(row.entry) for row in likely])
    known = featurised(sample, likely)
    return [list(likely.index)[e] for e in choose(known, len(likely.index), limit)]


def choose(known: list, entries: int, limit: int) -> list[int]:
    """Entries that together explain the toxic documents, from rows with ``label`` and ``found``.

    An entry's gain is its number of toxic documents, each counting less the more chosen entries it
    has, minus a charge for its clean ones. So the other words of a toxic text with many copies gain
    nothing once the telling ones are chosen.
    """
    toxic: list[list[int]] = [[] for _ in range(entries)]
    clean = [0] * entries
    for number, row in enumerate(known):
        for e in row.found:
            if e < entries:
                if row.label > 0:
                    toxic[e].append(number)
                else:
                    clean[e] += 1
    worth = {number: 1.0 for number, row in enumerate(known) if row.label > 0}

    def gain(e: int) -> float:
        return sum(worth[d] for d in toxic[e]) - CHARGE * clean[e]

    heap = [(-gain(e), e) for e in range(entries)]
    heapq.heapify(heap)
    chosen = []
    while heap and len(chosen) < limit:
        _, e = heapq.heappop(heap)
        now = gain(e)  # gains only fall, so an entry that stays ahead of the next is the best
        if now < LEAST_GAIN:
            continue
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, e))
            continue
        chosen.append(e)
        for d in toxic[e]:
            worth[d] *= FADE
    return chosen


def featurised(sample: DataFrame, voters: Voters) -> list:
    """Rows of label and features; no more than the sample's bound."""

    def featurise(batches):
        for batch in batches:
            found = [voters.features(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    return sample.mapInArrow(featurise, "label int, found array<int>").collect()


def words_in(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(WORD_BYTES).split())


class Voters:
    """Lexicon entries of a text and the votes that follow from them."""

    def __init__(self, lexicon: list[bytes]):
        self.index = {entry: i for i, entry in enumerate(lexicon)}
        # Words whose beginning no entry has need no further look.
        self.gate = frozenset(e[1:5] if e[:1] == b" " else e[:4] for e in lexicon)
        self.voter: list[int] = []
        dealt = [0, 0]
        for entry in lexicon:
            stem = entry[:1] == b" "
            self.voter.append(WORD_VOTERS + dealt[1] % STEM_VOTERS if stem else dealt[0] % WORD_VOTERS)
            dealt[stem] += 1
        self.size = len(lexicon) + len(PATTERNS)
        self.voters = WORD_VOTERS + STEM_VOTERS + len(PATTERNS)

    def features(self, text: str | None) -> list[int]:
        """Lexicon entries that a text has, then patterns that it fits."""
        data = (text or "").encode()
        gate = self.gate
        near = {w for w in set(data.translate(WORD_BYTES).split()) if w[:4] in gate}
        index = self.index
        found = [index[e] for e in entries_of(near) if e in index] if near else []
        first = len(self.index)
        return found + [first + k for k, fits in enumerate(PATTERNS) if fits(data)]

    def votes(self, features: list[int]) -> int:
        """Bit v is set where voter v fires."""
        first, mask = len(self.voter), 0
        for f in features:
            mask |= 1 << (self.voter[f] if f < first else WORD_VOTERS + STEM_VOTERS + f - first)
        return mask

    def unpacked(self, masks: np.ndarray) -> np.ndarray:
        """A column for each voter, and one for whether any fires."""
        fired = (masks[:, None] >> np.arange(self.voters) & 1).astype(float)
        return np.column_stack([fired, masks > 0])


@dataclass
class LabelModel:
    """Rates at which voters fire in either class, and how far each repeats what others say.

    A silent voter abstains. That any voter fires at all is the first piece of evidence (the last
    column of the votes); which ones fire is the rest. There a voter's evidence is divided by one plus
    its correlations with the others within the toxic class, so that voters that always fire together
    count about once.
    """

    share: float  # of the toxic class
    rates: np.ndarray  # class x voter, any voter last
    correlations: np.ndarray  # within the toxic class, without the last

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        rates = np.clip(self.rates, 1e-6, 1 - 1e-6)
        any_fires = np.log(rates[1, -1] / rates[0, -1])
        none_fires = np.log((1 - rates[1, -1]) / (1 - rates[0, -1]))
        others = np.clip(self.correlations, 0, None).sum(axis=1) - np.diag(self.correlations)
        which = (np.log(rates[1, :-1] / rates[0, :-1]) - any_fires) / (1 + np.clip(others, 0, None))
        fired = votes[:, -1]
        return votes[:, :-1] @ which + fired * any_fires + (1 - fired) * none_fires + np.log(
            self.share / (1 - self.share))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(votes))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def moments(votes: np.ndarray, weight: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Weighted sums of one, the votes and their products, by class; flat."""
    parts = []
    for w in (weight * (1 - posterior), weight * posterior):
        parts += [[w.sum()], votes.T @ w, (votes.T @ (w[:, None] * votes)).ravel()]
    return np.concatenate(parts)


def model_from(total: np.ndarray, voters: int) -> LabelModel:
    """The likeliest model for sums of moments, with a document of even odds mixed in."""
    (n0, s0, _), (n1, s1, p1) = (
        (half[0], half[1:1 + voters], half[1 + voters:].reshape(voters, voters))
        for half in np.split(total, 2))
    rates = np.stack([(s0 + 0.01) / (n0 + 1), (s1 + 0.1) / (n1 + 1)])
    mean = s1 / max(n1, 1)
    covariance = p1 / max(n1, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(covariance), 1e-9, None))
    correlations = (covariance / np.outer(spread, spread))[:-1, :-1]
    share = np.clip((n1 + 0.5) / (n0 + n1 + 1), 1e-4, 1 - 1e-4)
    return LabelModel(float(share), rates, correlations)


def vote_table(docs: DataFrame, voters: Voters, text_column: str) -> DataFrame:
    """(votes, docs): how many documents show each set of votes."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            seen.update(
                voters.votes(voters.features(text)) for text in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
            names=["votes", "docs"])

    counted = docs.select(text_column).mapInArrow(count, "votes long, docs long")
    return materialise(counted.groupBy("votes").agg(F.sum("docs").alias("docs")), "votes")


def fit_label_model(table: DataFrame, voters: Voters, gold: np.ndarray, rounds: int) -> LabelModel:
    """Expectation maximisation; each round adds up one row of moments per task.

    It starts from the moments of the labelled sample, which also stay in every round, so that the
    classes keep their meaning.
    """
    columns = voters.voters + 1
    model = model_from(gold, columns)
    share = gold / (gold[0] + gold[len(gold) // 2])
    for _ in range(rounds):

        def add_up(batches, model=model):
            total = np.zeros(2 * (1 + columns + columns**2))
            for batch in batches:
                votes = voters.unpacked(batch.column(0).to_numpy())
                total += moments(votes, batch.column(1).to_numpy(), model.posterior(votes))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["moments"])

        parts = table.mapInArrow(add_up, "moments binary").collect()
        total = sum(np.frombuffer(row.moments) for row in parts)
        documents = total[0] + total[len(total) // 2]
        model = model_from(total + ANCHOR * documents * share, columns)
    return model


def fit_linear(
    features: np.ndarray, target: np.ndarray, penalty: float = 1e-4, steps: int = 400,
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient steps of adaptive size."""
    weights, bias = np.zeros(features.shape[1]), 0.0
    first, second = np.zeros(features.shape[1] + 1), np.zeros(features.shape[1] + 1)
    for step in range(1, steps + 1):
        error = (sigmoid(features @ weights + bias) - target) / len(target)
        slope = np.append(features.T @ error + penalty * weights, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def scores(self, texts: list[str | None]) -> list[float]:
        found = [self.weights[self.voters.features(text)].sum() for text in texts]
        return sigmoid(np.array(found) + self.bias).tolist()


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", entries: int = ENTRIES,
    id_column: str = "doc_id", text_column: str = "text",
) -> Classifier:
    """Mine the lexicon, fit the label model to all documents' votes, train the classifier.

    Without labels of both classes in the sample there is no lexicon, and every score is the share
    of toxic labels in the sample (0 if it is empty).
    """
    sample = materialise(
        labelled_sample(docs, labels, label, FOLDS, HELD_OUT, id_column, text_column)
        .dropDuplicates(), "sample")
    voters = Voters(mine_lexicon(sample, entries))
    known = featurised(sample, voters)
    gold = np.array([row.label > 0 for row in known], float)
    if not voters.index or not 0 < gold.sum() < len(gold):
        share = gold.mean() if len(gold) else 0.0
        bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
        return Classifier(voters, np.zeros(voters.size), bias)
    votes = voters.unpacked(np.array([voters.votes(row.found) for row in known], np.int64))
    known_moments = moments(votes, np.ones(len(gold)), gold)
    model = fit_label_model(
        vote_table(docs, voters, text_column), voters, known_moments, ROUNDS)
    features = np.zeros((len(known), voters.size), np.float32)
    for i, row in enumerate(known):
        features[i, row.found] = 1
    weights, bias = fit_linear(features, model.posterior(votes))
    return Classifier(voters, weights, float(bias), model)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` (score of 0.3 or more).

    Texts alone decide the score; null and empty ones score as texts without a lexicon entry. Null
    ids stay null and are not held out, repeated rows are scored each, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        fit(docs, labels, id_column=id_column, text_column=text_column))

    def scores(batches):
        for texts in batches:
            yield shared.value.scores(texts)

    return with_scores(docs, scores, FOLDS, HELD_OUT, THRESHOLD, id_column, text_column)
