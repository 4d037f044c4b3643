"""Hard negatives by the threshold algorithm over sorted lists of every dimension.

For an anchor, the rows of its own label that score highest are its positives; its hard negatives are
the best rows of other labels whose score lies in a window below the positive's. Scores are inner
products of integers, so ties and bounds are exact.

Rows are dealt into shards. A shard has a list of its rows for each dimension, sorted by component. An
anchor reads all lists side by side, each from the end that the sign of its own component favours, scores
every row it meets by its whole vector, and goes on deeper. The components at the depth reached bound
the score of all rows not met yet; reading stops when that threshold is strictly below the k-th score
found in each window, or below the window: an equal score could still win by its smaller id. The
shards' finds are then brought together by anchor.

A shard holds a bounded number of rows; anchors stream past it, sorted behind its rows, so no task holds
all anchors or all rows, and labels play no part in the dealing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encore.session import materialise

STEP, CLASSES = 256, 10  # of the components; of the labels
MOVED, ANCHORS = 7, 50  # ids divisible by these get the next label, or are anchors
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # percent of the positive's score
SHARD_ROWS = 1 << 17  # at most, about
SMALL_SHARD = 2048  # where there are fewer rows than cores times this, shards are smaller
FIRST_DEPTH = 32  # doubled until the threshold stops the reading


class Shard:
    """Rows of one dimension with their sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.labels = ids, rows, labels
        self.wide = vectors.astype(np.int64)
        self.most = int(np.abs(self.wide).max(initial=0))
        # Doubles add integers of this size exactly, and faster.
        self.vectors = vectors.astype(float)
        self.up = np.argsort(vectors, axis=0, kind="stable").T.copy()  # by dimension, ascending
        self.ascending = np.take_along_axis(self.wide, self.up.T, axis=0).T.copy()

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bound = len(anchor) * self.most * int(np.abs(anchor).max(initial=0))
        if bound < 1 << 53:
            return (self.vectors[rows] @ anchor.astype(float)).astype(np.int64)
        if bound < 1 << 63:
            return self.wide[rows] @ anchor
        exact = [sum(int(x) * int(y) for x, y in zip(row, anchor, strict=True)) for row in self.wide[rows]]
        if any(abs(score) >= 1 << 63 for score in exact):
            raise OverflowError("an inner product does not fit 64 bits")
        return np.array(exact, np.int64)

    def bound(self, anchor: np.ndarray, depth: int) -> int:
        """No row below this depth in all lists scores more."""
        place = np.where(anchor >= 0, len(self.rows) - depth - 1, depth)
        edge = self.ascending[np.arange(len(anchor)), place]
        return sum(int(a) * int(v) for a, v in zip(anchor, edge, strict=True))

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]],
               k: int) -> list[list[tuple[int, int]]]:
        """(score, row) of the best k allowed rows of each window (least and most score), by score, then id."""
        count = len(self.rows)
        met, open_ = ~allowed, [True] * len(windows)
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        falling, rising = anchor >= 0, anchor < 0
        start, depth = 0, min(FIRST_DEPTH, count)
        while True:
            lists = [self.up[falling, count - depth:count - start], self.up[rising, start:depth]]
            fresh = np.zeros(count, bool)
            for part in lists:
                fresh[part.ravel()] = True
            fresh &= ~met
            new = np.flatnonzero(fresh)
            met[new] = True
            if len(new):
                scores = self.scores(anchor, new)
                for w, (least, most) in enumerate(windows):
                    if open_[w]:
                        found[w] = self._best(found[w], new, scores, least, most, k)
            if depth == count:
                return [[(score, row) for score, _, row in best] for best in found]
            threshold = self.bound(anchor, depth)
            for w, (least, _) in enumerate(windows):
                done = len(found[w]) == k and threshold < found[w][-1][0]
                open_[w] = open_[w] and not done and (least is None or threshold >= least)
            if not any(open_):
                return [[(score, row) for score, _, row in best] for best in found]
            start, depth = depth, min(2 * depth, count)

    def _best(self, before, new, scores, least, most, k):
        inside = np.ones(len(new), bool)
        if least is not None:
            inside = (scores >= least) & (scores <= most)
        new, scores = new[inside], scores[inside]
        if len(new) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            if len(before) == k:
                edge = max(edge, before[-1][0])
            high = scores >= edge
            new, scores = new[high], scores[high]
            order = np.lexsort((self.ids[new], -scores))[:k]
            new, scores = new[order], scores[order]
        both = before + [(s, self.ids[r], r) for s, r in zip(scores.tolist(), new.tolist(), strict=True)]
        return sorted(both, key=lambda x: (-x[0], x[1]))[:k]


def window(positive: int) -> tuple[int, int]:
    """Least and most score that a hard negative may have."""
    return -((-LEAST * positive) // 100), (MOST * positive) // 100


def quantised(
    embeddings: DataFrame, id_column: str, vector_column: str, label_column: str,
) -> DataFrame:
    """(row, id, label, vector) of the rows that take part: integer components, moved labels, a row number."""
    x = F.col("vector")
    sound = x.isNotNull() & F.col("label").isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    read = embeddings.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector")).filter(sound)
    moved = F.when(F.col("id") % MOVED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    # An empty vector scores 0 with another empty one, as a vector of one zero does.
    padded = F.when(F.size(x) == 0, F.array(F.lit(0.0))).otherwise(x)
    return read.select(
        F.monotonically_increasing_id().alias("row"), "id", moved.alias("label"),
        F.size(x).alias("size"), F.transform(padded, lambda c: F.floor(c * STEP)).alias("vector"))



def _matches(rows: DataFrame, anchors: DataFrame, shards: int, k: int) -> DataFrame:
    """(anchor_row, anchor_id, target, found_id, score): each shard's best k of each window of each anchor.

    Anchors with ``wanted`` (positives' scores) look for other labels in their windows, those without for
    their own label.
    """
    dealt = rows.select(
        (F.pmod(F.xxhash64("row"), F.lit(shards))).cast("int").alias("shard"), F.lit(0).alias("kind"),
        "row", "id", "label", "size", "vector", F.lit(None).cast("array<bigint>").alias("wanted"))
    sent = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"),
        "row", "id", "label", "size", "vector", "wanted")
    ordered = dealt.unionByName(sent).repartitionById(shards, F.col("shard")).sortWithinPartitions(
        "shard", "kind", "row")  # a shard for each task

    def search(batches):
        names = ["anchor_row", "anchor_id", "target", "found_id", "score"]
        for found in _searched(batches, k):
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == "target" else pa.int64())
                 for c, n in zip(columns, names, strict=True)], names=names)

    return ordered.mapInArrow(
        search, "anchor_row long, anchor_id long, target int, found_id long, score long")


def _numbers(batch: pa.RecordBatch, name: str, missing: int = np.iinfo(np.int64).max) -> np.ndarray:
    """A long column; nulls become the largest number."""
    return batch.column(name).cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple]]:
    waiting: dict[int, list] = {}
    shards: dict[int, Shard] = {}
    current = None
    for batch in batches:
        shard, kind = _numbers(batch, "shard"), _numbers(batch, "kind")
        rows, ids, labels, sizes = (_numbers(batch, n) for n in ("row", "id", "label", "size"))
        offsets = batch.column("vector").offsets.to_numpy()
        values = batch.column("vector").values.to_numpy(zero_copy_only=False)
        wanted, names = batch.column("wanted").to_pylist(), batch.column("id").to_pylist()
        found = []
        for own in np.unique(shard):  # a few at most
            if own != current:
                current, waiting, shards = own, {}, {}
            members = np.flatnonzero((shard == own) & (kind == 0))
            for size in np.unique(sizes[members]):
                at = members[sizes[members] == size]
                width = max(int(size), 1)
                place = offsets[at][:, None] + np.arange(width)
                waiting.setdefault(int(size), []).append((ids[at], rows[at], labels[at], values[place]))
            anchors = np.flatnonzero((shard == own) & (kind == 1))
            if len(anchors) and waiting:
                shards = {size: Shard(*[np.concatenate(p) for p in zip(*parts, strict=True)])
                          for size, parts in waiting.items()}
                waiting = {}
            for a in anchors:
                held = shards.get(int(sizes[a]))
                if held is None:
                    continue
                vector = values[offsets[a]:offsets[a + 1]]
                if wanted[a] is None:
                    allowed = (held.labels == labels[a]) & (held.rows != rows[a])
                    windows = [(None, None)]
                else:
                    allowed = held.labels != labels[a]
                    windows = [window(score) for score in wanted[a]]
                for target, best in enumerate(held.search(vector, allowed, windows, k)):
                    found += [(int(rows[a]), names[a], target, None if held.ids[r] == np.iinfo(np.int64).max
                               else int(held.ids[r]), score) for score, r in best]
        yield found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and target over all shards, with their ``rank``."""
    order = W.partitionBy("anchor_row", "target").orderBy(F.desc("score"), F.asc_nulls_last("found_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shard_count(rows: int, cores: int) -> int:
    return max(1, -(-rows // SHARD_ROWS), min(cores, -(-rows // SMALL_SHARD)))


def hard_negatives(
    embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label", anchor: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label or vector or a null or non-finite component take no part; rows with a null id
    do, behind all others of equal score, but are no anchors (``anchor`` chooses these, by default ids
    divisible by 50). Vectors of another length than the anchor's are not compared with it. Every row
    counts, repeated ones too: each of equal anchor rows is an anchor and has the others as rows. A
    positive without negatives in its window gives no row, nor does an empty table. Other columns are
    not read. Inner products beyond 64 bits raise an error.
    """
    spark = embeddings.sparkSession
    rows = materialise(quantised(embeddings, id_column, vector_column, label_column), "quantised")
    chosen = F.col("id") % ANCHORS == 0 if anchor is None else anchor
    shards = shard_count(rows.count(), spark.sparkContext.defaultParallelism)
    anchors = rows.filter(chosen).withColumn("wanted", F.lit(None).cast("array<bigint>"))
    near = materialise(_ranked(_matches(rows, anchors, shards, POSITIVES), POSITIVES).select(
        "anchor_row", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("anchor_row").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]
    ).alias("wanted"))  # at most POSITIVES each
    seeking = rows.filter(chosen).join(scores.withColumnRenamed("anchor_row", "row"), "row")
    found = _ranked(_matches(rows, seeking, shards, NEGATIVES), NEGATIVES)
    return found.select(
        "anchor_row", "anchor_id", (F.col("target") + 1).alias("place"), "rank",
        F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"),
    ).join(near, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")
