"""SimHash near-duplicates by anchors of a covering code.

The first 46 of the 64 bits are two blocks of 23, and the anchors are pairs of words of the perfect
binary Golay code, which covers each block with radius 3: every fingerprint has one home anchor, at
most 3 bits away in each block. A fingerprint visits each anchor that is the home of some fingerprint
within the threshold of it (so within covering radius plus threshold in each block, the spare bits
shared between the blocks); about 61 anchors for a threshold of 2. Two fingerprints within the
threshold therefore meet where the smaller has its home, and are compared there only. The 18
remaining bits take no part in the anchors, only in the comparison.

Equal fingerprints are one class before that, so copies are not compared.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import LOWER_BYTES, compact, unused
from encore.llm.components import components
from encore.session import materialise

# The binary Golay code of length 23.
GENERATOR, LENGTH, CHECKS, RADIUS = 0b110001110101, 23, 11, 3
SEED = 42
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
BLOCK = (1 << LENGTH) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit b is set where more than half the shingles' hashes have it; no words give 0."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    width = min(shingle, len(words))
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([
        digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)
    ])
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.concatenate([
        np.bincount(table[:, k], minlength=256) @ BYTE_BITS for k in range(8)
    ])
    return int.from_bytes(np.packbits(2 * ones > len(table)).tobytes(), "big")


def remainder(word: int) -> int:
    """Remainder of a block's polynomial by the generator: its syndrome."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def light_words(weight: int) -> np.ndarray:
    """All block words with at most so many bits, lightest first."""
    words = layer = [0]
    for _ in range(weight):
        layer = [w | 1 << b for w in layer for b in range(LENGTH) if w >> b == 0]
        words = words + layer
    return np.array(words, np.int64)


@cache
def syndrome_tables() -> np.ndarray:
    """Syndromes of each byte of a block, to be combined by exclusive or."""
    return np.array([[remainder((v << 8 * k) & BLOCK) for v in range(256)] for k in range(3)])


def syndromes(blocks: np.ndarray) -> np.ndarray:
    t = syndrome_tables()
    return t[0][blocks & 255] ^ t[1][blocks >> 8 & 255] ^ t[2][blocks >> 16]


@cache
def leaders() -> np.ndarray:
    """The unique word of weight at most 3 for each syndrome: the code is perfect."""
    words = light_words(RADIUS)
    table = np.full(1 << CHECKS, -1, np.int64)
    table[syndromes(words)] = words
    return table


@cache
def visits(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome of y: steps from y to the homes of all x near y, the bits that x differs by in
    this block, and how many there are (rows are padded)."""
    near = light_words(threshold)
    bits = np.array([int(m).bit_count() for m in near])
    found = []
    for s in range(1 << CHECKS):
        steps = near ^ leaders()[s ^ syndromes(near)]
        _, first = np.unique(steps, return_index=True)  # lightest first, so the least bits
        found.append((steps[first], bits[first]))
    counts = np.array([len(steps) for steps, _ in found])
    width = counts.max()
    steps, cost = np.zeros((len(found), width), np.int64), np.full((len(found), width), 99)
    for s, (a, b) in enumerate(found):
        steps[s, :len(a)], cost[s, :len(b)] = a, b
    return steps, cost, counts


def home_anchors(prints: np.ndarray) -> np.ndarray:
    first, second = prints & BLOCK, prints >> LENGTH & BLOCK
    first ^= leaders()[syndromes(first)]
    second ^= leaders()[syndromes(second)]
    return second << LENGTH | first


def visited_anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor that it visits."""
    steps, cost, _ = visits(threshold)
    first, second = prints & BLOCK, prints >> LENGTH & BLOCK
    s1, s2 = syndromes(first), syndromes(second)
    total = cost[s1][:, :, None] + cost[s2][:, None, :]
    row, i, j = np.nonzero(total <= threshold)
    anchors = (second[row] ^ steps[s2[row], j]) << LENGTH | (first[row] ^ steps[s1[row], i])
    return row, anchors


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, fingerprint as long) for each row."""

    def compute(batches):
        for batch in batches:
            prints = [fingerprint(text) for text in batch.column(1).to_pylist()]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed)], names=["id", "print"])

    read = docs.select(id_column, text_column)
    kind = read.schema[id_column].dataType.simpleString()
    return read.mapInArrow(compute, f"id {kind}, print long")


def near_links(prints: DataFrame, threshold: int) -> DataFrame:
    """(a, b) pairs of different fingerprints within the threshold, each once, from ``print``."""

    def homes(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(home_anchors(values)), batch.column(0)], names=["anchor", "a"])

    def visitors(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2000):
                part = values[at:at + 2000]
                row, anchors = visited_anchors(part, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors), pa.array(part[row])], names=["anchor", "b"])

    prints = prints.select("print")
    at_home = prints.mapInArrow(homes, "anchor long, a long")
    visiting = prints.mapInArrow(visitors, "anchor long, b long")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return visiting.join(at_home, "anchor").filter((F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(
    docs: DataFrame, threshold: int = 2, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints are linked at up to ``threshold`` differing bits, and ``component_id`` is the
    smallest id that links lead to. Null, empty and blank texts have fingerprint zero, which is
    linked like any other. Rows with a null id keep it and join the component of their fingerprint,
    null if no row of it has an id. Repeated rows are returned each; other columns are not read.
    """
    prints = materialise(fingerprints(docs, id_column, text_column), "prints")
    classes = materialise(prints.groupBy("print").agg(F.min("id").alias("least")), "print-classes")
    links = compact(near_links(classes, threshold), "print-links")
    least = classes.join(
        components(links).withColumnRenamed("node", "print"), "print", "left"
    ).withColumn("component", F.coalesce("component", "print"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.select("print", "component").join(smallest, "component").select(
        "print", "component_id")
    return prints.join(materialise(named, "print-components"), "print").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id",
    )


def keep_first(
    docs: DataFrame, threshold: int = 2, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns.

    Rows without an id stay only where their component has no id at all; of rows that share the
    smallest id, and of those without one, the first by a hash of the text stays.
    """
    # The hash tells rows of one id apart; rows without an id come last.
    row_hash = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    keyed = docs.select(
        F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"),
                 row_hash.alias("hash")).alias("key"), F.col(text_column).alias("text"))
    found = near_duplicates(keyed, threshold, "key", "text")
    gone_id, gone_hash = unused(docs, "gone_id"), unused(docs, "gone_hash")
    columns = [F.col("key.id").alias(gone_id), F.col("key.hash").alias(gone_hash)]
    is_first = F.col("key") == F.col("component_id")
    # Keys that go, and first keys that more than one row has: few beside the rows that stay.
    marked = compact(
        found.groupBy("key").agg(F.max(is_first).alias("first"), F.count("*").alias("key_rows"))
        .filter("not first or key_rows > 1").select("first", *columns), "print-gone")
    same = F.col(id_column).eqNullSafe(F.col(gone_id)) & (row_hash == F.col(gone_hash))
    single = docs.join(marked.drop("first"), same, "left_anti")
    repeated = marked.filter("first").drop("first")
    if repeated.isEmpty():
        return single
    return single.unionByName(
        docs.join(repeated, same, "left_semi").dropDuplicates([id_column, text_column]))
