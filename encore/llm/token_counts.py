"""Exact token counts of byte-level byte-pair vocabularies, without making token ids.

A text is split into pieces by the vocabulary's pattern. Each piece is a linked list of byte
symbols; a heap holds the adjacent pairs that have a rank. The pair of lowest rank (the leftmost
of equals) is merged until no ranked pair is left, so a piece has as many tokens as symbols minus
merges. The merge table is bounded by the vocabulary file and goes to the tasks as a broadcast.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The pattern of byte-level vocabularies. White space is the Unicode property.
SPACE = r"\p{White_Space}"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!\S)|{SPACE}+"
).replace(r"(?!\S)", rf"(?![^{SPACE}])")
CACHED_PIECES = 1 << 18  # in each of two generations
COUNTS = "n_bytes long, n_tokens long, over_limit boolean"


@dataclass(frozen=True)
class Vocabulary:
    """What counting needs of a vocabulary: the ranks of its merges and its special strings."""

    ranks: dict[tuple[str, str], int]
    special: tuple[str, ...]


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable, else the next free character."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in kept else next(free)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level vocabulary file; raise where it asks for more than merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split, model = spec["pre_tokenizer"], spec["model"]
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    if model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path} does not tokenize by merges alone")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    for token in spec["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"special string {token['content']!r} takes in its surroundings")
    special = tuple(token["content"] for token in spec["added_tokens"])
    return Vocabulary({pair: rank for rank, pair in enumerate(pairs)}, special)


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when no adjacent pair has a rank; empties ``symbols``' meaning."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [
        (rank, i, symbols[i], symbols[i + 1])
        for i in range(n - 1)
        if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
    ]
    heapq.heapify(heap)
    alive = n
    while heap:
        _, i, first, second = heapq.heappop(heap)
        j = right[i]
        if j >= n or symbols[i] != first or symbols[j] != second:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = first + second, ""
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        alive -= 1
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n:
                rank = ranks.get((symbols[a], symbols[b]))
                if rank is not None:
                    heapq.heappush(heap, (rank, a, symbols[a], symbols[b]))
    return alive


class Counter:
    """Counts the tokens of texts; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks
        self.symbols = byte_symbols()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.find = regex.compile(PIECES).findall
        self.special = (
            regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len)[::-1])))
            if vocabulary.special else None
        )

    def piece(self, piece: str) -> int:
        count = self.older.get(piece) or merged_length(
            [self.symbols[b] for b in piece.encode()], self.ranks
        )
        if len(piece) <= 64:  # longer ones hardly come back
            if len(self.known) >= CACHED_PIECES:
                self.older, self.known = self.known, {}
            self.known[piece] = count
        return count

    def plain(self, text: str) -> int:
        known, total = self.known.get, 0
        for piece in self.find(text):
            total += known(piece) or self.piece(piece)
        return total

    def text(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    A null text counts as empty (0, 0, false); a null id stays null; repeated rows are counted
    one by one; other columns are not read. Very long texts and pieces take n log n steps.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    def count(batches):
        counter = Counter(shared.value)
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                sizes.append(len(text.encode()) if text else 0)
                counts.append(counter.text(text) if text else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    read = docs.select(id_column, text_column)
    kind = read.schema[id_column].dataType.simpleString()
    return read.mapInArrow(count, f"`{id_column}` {kind}, {COUNTS}")
