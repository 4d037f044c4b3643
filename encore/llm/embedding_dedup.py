"""Near-duplicate vectors by sorted projection passes.

In each pass a vector gets a key of concatenated random hashes: the largest coordinate, with its sign,
after each of several random rotations. The vectors are sorted by these keys over the cluster, and each
is compared with a bounded window of its neighbours, also across the tasks' borders. Pairs whose cosine
reaches the threshold join components; the passes together leave hardly a near pair in two components,
and ``across_links`` finds those that they do leave.

The length of the keys, the window and the number of passes follow the table (``plan``): keys are so
long that the vectors that share one fit the window, also in a topic whose vectors have a direction in
common, and the longer they are, the more passes it takes until a near pair has shared one.

What the passes leave apart is found by comparing the vectors of different components, block by block:
no near pair is lost, whatever the plan. That is quadratic in the distinct vectors, in tasks of bounded size.

Counting a vector's links must not stop at a window, so inside a component every pair is decided
exactly, too. The angles to a pivot decide most of them, by the triangle inequality,
from counts of vectors by angle; blocks of vectors are compared only where that does not. A group of
copies and near copies of any size costs counts, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import compact
from encore.llm.components import components
from encore.session import materialise

THRESHOLD, PASSES, SYMBOLS, WINDOW = 0.9, 16, 4, 128  # the last three: at least
WIDEST, LONGEST = 1024, 64  # window and symbols of a key, at most
MISSED = 0.02  # share of pairs at the threshold that the passes may leave apart
ROTATIONS = 64  # different ones; more symbols come from changes of sign before them
PROBE_ROWS, PROBE_SHARE = 2000, 0.01  # vectors that ``plan`` looks at; share of them denser than it plans for
ANGLE_STEP = 0.02  # of the counts by angle, in radians
BLOCK = 1024  # vectors compared with as many others at once
TASK_ROWS = 20_000
SIDE_ROWS = 8192  # vectors on either side of a task that compares components
SLACK = 1e-6  # angles closer to a bound than this are not decided by it


@cache
def rotation(dimension: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    draw = np.random.default_rng([dimension, number])
    q, r = np.linalg.qr(draw.standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


@cache
def signs(dimension: int, number: int) -> np.ndarray:
    return np.random.default_rng([dimension, number, 1]).choice([-1.0, 1.0], dimension)


def pass_keys(unit: np.ndarray, number: int, symbols: int) -> np.ndarray:
    """Concatenated hashes of unit vectors, a row of symbols each that compares as bytes."""
    dimension = unit.shape[1]
    key = np.empty((len(unit), symbols), ">u4")
    for k in range(symbols):
        turn = number * symbols + k
        turned = (unit * signs(dimension, turn)) @ rotation(dimension, turn % ROTATIONS)
        at = np.abs(turned).argmax(axis=1)
        key[:, k] = 2 * at + (turned[np.arange(len(at)), at] < 0)
    return key


@cache
def shared_symbol(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, chance that two vectors of this cosine have the same symbol), by simulation."""
    draw = np.random.default_rng([dimension, 2])
    one, other = draw.standard_normal((2, 2000, dimension))

    def symbol(x):
        at = np.abs(x).argmax(axis=1)
        return 2 * at + (x[np.arange(len(x)), at] < 0)

    cosines = np.linspace(0, 1, 41)
    same = [(symbol(one) == symbol(c * one + math.sqrt(1 - c * c) * other)).mean() for c in cosines]
    return cosines, np.maximum.accumulate(np.maximum(same, 1 / (2 * dimension)))


def plan(probe: list[np.ndarray], share: float, threshold: float) -> tuple[int, int, int]:
    """(passes, symbols, window) for a table of which ``probe`` (units, by dimension) is a sample.

    ``share`` is the number of vectors that one of the sample stands for. Of the windows the one
    with the least work is taken.
    """
    passes, symbols, window = PASSES, SYMBOLS, WINDOW
    for unit in probe:
        dimension = unit.shape[1]
        cosines, chance = shared_symbol(dimension)
        cosine = unit @ unit.T
        # Those that are linked anyway stand together in any window.
        same = np.where(cosine >= threshold, 0, np.interp(cosine, cosines, chance))
        crowd, power = [], np.ones_like(same)
        for _ in range(LONGEST):
            power *= same
            crowd.append(share * np.quantile(power.sum(axis=1), 1 - PROBE_SHARE))
        near = float(np.interp(threshold, cosines, chance))
        best = None
        width = WINDOW
        while width <= WIDEST:
            length = next((k for k, n in enumerate(crowd, 1) if n <= width / 2), LONGEST)
            # Pairs that part at a symbol are found if they stand close in the crowd before it.
            close = [min(1, width / max(n, 1)) for n in [share * len(unit), *crowd[:length]]]
            found = sum(near**k * (1 - near) * c for k, c in enumerate(close[:-1]))
            found += near**length * close[-1]
            needed = math.ceil(math.log(MISSED) / math.log1p(-min(found, 0.999)))
            needed = max(PASSES, needed)
            work = needed * (max(length, SYMBOLS) * dimension + 2 * width)
            if best is None or work < best[0]:
                best = (work, needed, length, width)
            width *= 2
        passes, symbols, window = (max(x) for x in zip(
            (passes, symbols, window), best[1:], strict=True))
    return passes, symbols, window


def unpack(vectors: list[bytes], dimension: int) -> np.ndarray:
    """Unit vectors in double precision."""
    table = np.frombuffer(b"".join(vectors), "<f8").reshape(-1, dimension)
    table = table / np.abs(table).max(axis=1, keepdims=True)  # keeps squares in range
    return table / np.sqrt((table * table).sum(axis=1, keepdims=True))


def pack(batches: Iterator[pa.RecordBatch]):
    """(id, vector as bytes); null for vectors that cannot be linked."""
    for batch in batches:
        packed = []
        for values in batch.column(1).to_pylist():
            vector = None
            if values and None not in values:
                vector = np.array(values, "<f8")
                if not np.isfinite(vector).all() or not vector.any():
                    vector = None
            packed.append(None if vector is None else vector.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary())], names=["id", "vector"])


def keyed(passes: int, symbols: int):
    """(pass, dimension, key, node, vector) of (node, vector) rows, for each pass."""

    def make(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            vectors = np.array(batch.column(1).to_pylist(), object)
            sizes = np.array([len(v) // 8 for v in vectors], np.int32)
            for dimension in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dimension)
                unit = unpack(vectors[own].tolist(), dimension)
                packed = pa.array(vectors[own].tolist(), pa.binary())
                for number in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), number, np.int32)),
                         pa.array(np.full(len(own), dimension, np.int32)),
                         pa.array([k.tobytes() for k in pass_keys(unit, number, symbols)],
                                  pa.binary()), pa.array(nodes[own]), packed],
                        names=["pass", "dimension", "key", "node", "vector"])

    return make


class Parts:
    """Sets of nodes that links have joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = self.parent[x]
        return x

    def join(self, near: np.ndarray, rows: list[int], columns: list[int]) -> Iterator[tuple[int, int]]:
        """The links of a table of near pairs that join two parts; they join all that is near."""
        while near.any():
            tops = [np.array([self.top(x) for x in nodes]) for nodes in (rows, columns)]
            near = near & (tops[0][:, None] != tops[1])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                j = int(near[i].argmax())
                x, y = self.top(rows[i]), self.top(columns[j])
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    yield rows[i], columns[j]


LINKS = ("a long, b long, border int, place int, pass int, dimension int, node long, vector binary")


def neighbour_links(threshold: float, window: int):
    """(a, b) of near neighbours in sorted rows; within a task only links that join new parts.

    Also the first and last rows of a task, by the border that they stand at: those before it have
    negative places.
    """
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.binary()]
    names = [column.split()[0] for column in LINKS.split(", ")]

    def output(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def find(batches):
        parts, task = Parts(), TaskContext.get().partitionId()
        last, tail_nodes, tail = None, np.empty(0, np.int64), None
        head_rows, tail_rows = [], []
        for batch in batches:
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            nodes = batch.column(2).to_numpy()
            vectors = batch.column(3).to_pylist()
            ends = range(max(0, len(group) - window), len(group))
            row = lambda i: (*group[i], int(nodes[i]), vectors[i])  # noqa: B023, E731
            head_rows += [row(i) for i in range(min(window - len(head_rows), len(group)))]
            tail_rows = (tail_rows + [row(i) for i in ends])[-window:]
            edges = [i for i in range(len(group)) if i == 0 or group[i] != group[i - 1]]
            found = []
            for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
                if group[a] != last:  # another pass: nothing to compare with what came before
                    last, tail_nodes, tail = group[a], np.empty(0, np.int64), None
                unit = unpack(vectors[a:b], last[1])
                unit = unit if tail is None else np.concatenate([tail, unit])
                own = np.concatenate([tail_nodes, nodes[a:b]])
                for start in range(len(tail_nodes), len(own), window):
                    low, end = max(0, start - window), min(start + window, len(own))
                    step = np.arange(start, end)[:, None] - np.arange(low, end)
                    near = unit[start:end] @ unit[low:end].T >= threshold
                    near &= (step > 0) & (step <= window)
                    found += parts.join(near, own[start:end].tolist(), own[low:end].tolist())
                tail_nodes, tail = own[-window:], unit[-window:]
            if found:
                yield output([(x, y, *[None] * 6) for x, y in found])
        yield output([(None, None, task, i, *r) for i, r in enumerate(head_rows)]
                     + [(None, None, task + 1, i - len(tail_rows), *r)
                        for i, r in enumerate(tail_rows)])

    return find


def border_links(threshold: float, window: int) -> Callable[[pa.Table], pa.Table]:
    """(a, b) of near neighbours on two sides of a border between tasks."""

    def find(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(n).to_pylist() for n in (
            "place", "pass", "dimension", "node", "vector")), strict=True), key=lambda r: r[0])
        found = []
        kind = next((r[1:3] for r in rows if r[0] >= 0), None)
        before, after = ([r for r in rows if r[1:3] == kind and (r[0] < 0) == side]
                         for side in (True, False))
        if before and after:
            x, y = (unpack([r[4] for r in side], kind[1]) for side in (before, after))
            step = np.array([r[0] for r in after]) - np.array([r[0] for r in before])[:, None]
            near = (x @ y.T >= threshold) & (step <= window)
            found = list(Parts().join(near, [r[3] for r in before], [r[3] for r in after]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})

    return find


def side_links(threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """(a, b) of near vectors of two groups; of each two components only links that join new parts."""

    def find(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (value.as_py() for value in key)
        sides: dict[tuple, tuple[list, list]] = {}
        for side, node, component, vector in zip(
                *(table.column(n).to_pylist() for n in ("side", "node", "component", "vector")), strict=True):
            sides.setdefault((side, len(vector) // 8), []).append((component, node, vector))
        parts, found = Parts(), []
        for (side, dimension), left in sides.items():
            right = left if low == high else sides.get((1, dimension), [])
            if side or not right:
                continue
            x, y = (unpack([r[2] for r in rows], dimension) for rows in (left, right))
            labels = [np.array([r[0] for r in rows]) for rows in (left, right)]
            for i in range(0, len(left), BLOCK):
                for j in range(i if low == high else 0, len(right), BLOCK):
                    near = x[i:i + BLOCK] @ y[j:j + BLOCK].T >= threshold
                    if near.any():
                        near &= labels[0][i:i + BLOCK, None] != labels[1][j:j + BLOCK]
                        # Parts are sets of components here.
                        found += parts.join(near, labels[0][i:i + BLOCK].tolist(), labels[1][j:j + BLOCK].tolist())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()),
                         "b": pa.array([b for _, b in found], pa.int64())})

    return find


def across_links(members: DataFrame, count: int, threshold: float) -> DataFrame:
    """(a, b) of components that near vectors of (node, component, vector) rows link, all together.

    Every two vectors meet in a task: vectors are dealt to groups, and a task compares two of these. A group
    has about ``SIDE_ROWS`` vectors of the ``count``.
    """
    groups = max(1, -(-count // SIDE_ROWS))
    own = F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")
    dealt = members.withColumn("own", own).select(
        "own", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other"), "node", "component", "vector")
    return dealt.select(
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "component", "vector",
    ).groupBy("low", "high").applyInArrow(side_links(threshold), "a long, b long")


def pivot_buckets(batches: Iterator[pa.RecordBatch]):
    """Adds the bucket of each vector's angle to its pivot; drops the pivot."""
    for batch in batches:
        vectors, pivots = (batch.column(name).to_pylist() for name in ("vector", "pivot"))
        buckets = np.empty(len(vectors), np.int32)
        sizes = np.array([len(v) // 8 for v in vectors])
        for dimension in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dimension)
            x = unpack([vectors[i] for i in own], dimension)
            y = unpack([pivots[i] for i in own], dimension)
            # Accurate for small angles too.
            angle = 2 * np.arctan2(np.linalg.norm(x - y, axis=1), np.linalg.norm(x + y, axis=1))
            buckets[own] = np.floor(angle / ANGLE_STEP)
        names = ["component", "node", "weight", "vector"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(buckets)], names=[*names, "bucket"])


def block_links(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Weights of the vectors linked across pairs of blocks."""

    def count(table: pa.Table) -> pa.Table:
        pairs: dict[tuple, tuple[list, list]] = {}
        names = ("component", "low", "high", "low_part", "high_part", "side", "node", "weight", "vector")
        for *key, side, node, weight, vector in zip(
                *(table.column(n).to_pylist() for n in names), strict=True):
            pairs.setdefault(tuple(key), ([], []))[side].append((node, weight, vector))
        nodes, weights = [], []
        for (_, low, high, low_part, high_part), (left, right) in pairs.items():
            same = (low, low_part) == (high, high_part)
            right = left if same else right
            if not left or not right:
                continue
            dimension = len(left[0][2]) // 8
            x, y = (unpack([r[2] for r in rows], dimension) for rows in (left, right))
            near = x @ y.T >= threshold
            if same:
                np.fill_diagonal(near, False)
            for rows, linked, others in ((left, near, right), (right, near.T, left))[:2 - same]:
                nodes += [r[0] for r in rows]
                weights += (linked @ np.array([r[1] for r in others])).tolist()
        return pa.table({"node": pa.array(nodes, pa.int64()), "linked": pa.array(weights, pa.int64())})

    return count


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): weight of the other vectors linked to each, among (component, node, weight,
    vector) rows; pairs of one component only."""
    limit = math.acos(threshold)
    pivots = members.groupBy("component").agg(F.min_by("vector", "node").alias("pivot"))
    schema = "component long, node long, weight long, vector binary, bucket int"
    members = materialise(
        members.join(materialise(pivots, "pivots"), "component").mapInArrow(pivot_buckets, schema),
        "members")
    cells = materialise(members.groupBy("component", "bucket").agg(
        F.sum("weight").alias("weight"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")),
        "cells")
    one = cells.select("component", F.col("bucket").alias("low"), F.col("parts").alias("low_parts"))
    two = cells.select("component", F.col("bucket").alias("high"), F.col("parts").alias("high_parts"),
                       F.col("weight").alias("high_weight"))
    both = one.join(two, "component")  # a component has few cells
    sure = (F.col("low") + F.col("high") + 2) * ANGLE_STEP <= limit - SLACK
    apart = (F.abs(F.col("low") - F.col("high")) - 1) * ANGLE_STEP > limit + SLACK
    decided = both.filter(sure).groupBy("component", F.col("low").alias("bucket")).agg(
        F.sum("high_weight").alias("sure"),
        F.max((F.col("low") == F.col("high")).cast("int")).alias("own"))
    open_pairs = materialise(
        both.filter(~sure & ~apart & (F.col("low") <= F.col("high"))).drop("high_weight"), "open-cells")

    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = members.join(
        cells.select("component", "bucket", "parts"), ["component", "bucket"]).withColumn("part", part)
    key = ["component", "low", "high", "low_part", "high_part"]
    lower = placed.withColumnRenamed("bucket", "low").join(open_pairs, ["component", "low"]).select(
        "component", "low", "high", F.col("part").alias("low_part"),
        F.explode(F.sequence(F.lit(0), F.col("high_parts") - 1)).alias("high_part"),
        F.lit(0).alias("side"), "node", "weight", "vector"
    ).filter("low < high or low_part <= high_part")
    upper = placed.withColumnRenamed("bucket", "high").join(open_pairs, ["component", "high"]).select(
        "component", "low", "high", F.explode(F.sequence(F.lit(0), F.col("low_parts") - 1))
        .alias("low_part"), F.col("part").alias("high_part"),
        F.lit(1).alias("side"), "node", "weight", "vector"
    ).filter("low < high or low_part < high_part")
    compared = lower.unionByName(upper)
    tasks = max(1, -(-compared.count() // TASK_ROWS))
    counted = compared.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(tasks))).groupBy(
        "task").applyInArrow(block_links(threshold), "node long, linked long")
    explicit = counted.groupBy("node").agg(F.sum("linked").alias("linked"))
    return members.join(decided, ["component", "bucket"], "left").join(
        explicit, "node", "left").select(
        "node", (F.coalesce("sure", F.lit(0)) - F.coalesce("own", F.lit(0)) * F.col("weight")
                 + F.coalesce("linked", F.lit(0))).alias("linked"))


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, passes: int | None = None,
    window: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept`` (id = component_id).

    Vectors that are null, empty or zero or hold null or non-finite components have no links and are
    their own component; vectors of other lengths are not compared. Rows of equal vectors are linked
    with each other. Rows without an id count as vectors, and take the component of what they link
    with, null if there is no id in it; they are not kept. Other columns are not read.
    """
    read = table.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>"))
    rows = materialise(read.mapInArrow(
        pack, f"id {read.schema['id'].dataType.simpleString()}, vector binary"), "vectors")
    classes = materialise(
        rows.filter("vector is not null").groupBy("vector").agg(
            F.min("id").alias("least"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    count = classes.count()
    probe = classes.orderBy(F.xxhash64("node"), "node").limit(PROBE_ROWS).select("vector").collect()
    sizes: dict[int, list[bytes]] = {}
    for (vector,) in probe:
        sizes.setdefault(len(vector) // 8, []).append(bytes(vector))
    planned = plan([unpack(v, d) for d, v in sizes.items()], count / max(1, len(probe)), threshold)
    passes, symbols, window = passes or planned[0], planned[1], window or planned[2]
    # Tasks are many windows long, so that what stands beside a border is in the two tasks there.
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(max(tasks, count * passes // TASK_ROWS), count * passes // (16 * window)))
    order = ["pass", "dimension", "key", "tie", "node"]
    ordered = classes.select("node", "vector").mapInArrow(
        keyed(passes, symbols), "pass int, dimension int, key binary, node long, vector binary"
    ).withColumn("tie", F.xxhash64("node", "pass")).repartitionByRange(
        tasks, *order).sortWithinPartitions(*order).select("pass", "dimension", "node", "vector")
    passed = materialise(ordered.mapInArrow(neighbour_links(threshold, window), LINKS), "vector-passes")
    across = passed.filter("border is not null").groupBy("border").applyInArrow(
        border_links(threshold, window), "a long, b long")
    links = compact(passed.filter("a is not null").select("a", "b").unionByName(across),
                    "vector-links")
    linked = materialise(components(links), "vector-components")
    placed = materialise(classes.join(linked, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "vector"), "vector-places")
    left = compact(across_links(placed, count, threshold), "vector-left")
    if not left.isEmpty():  # links of components are links of their first vectors
        linked = materialise(components(links.unionByName(left)), "vector-components")
    smallest = classes.select("node", "least").join(linked, "node").groupBy("component").agg(
        F.min("least").alias("component_id"))
    counted = exact_links(
        classes.select("node", "weight", "vector").join(linked, "node").select(
            "component", "node", "weight", "vector"), threshold)
    found = linked.join(smallest, "component").join(counted, "node").select(
        "node", "component_id", "linked")
    known = materialise(
        classes.join(found, "node", "left").select(
            "vector", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id")), "vector-results")
    return rows.join(known, "vector", "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id")).cast("long")
        .alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
