"""Removal of repeated passages, by suffix arrays of shards.

A byte goes if a ``length``-byte string that covers it also starts earlier, in a smaller document or
before in the same one. Equal strings have the same minimizer (the least hash of their short grams),
so it decides where a string is looked at:

1. Every document is cut into runs of starts whose strings share a minimizer. Tasks drop copies of
   whole texts, and send hashes with places to buckets by hash; there, minimizers that occur once in
   the corpus are left out, unless their gram stands twice in the stretch of their run: a string can
   start twice in it.
2. The stretches of text of the remaining runs are dealt to shards by minimizer. In a shard, equal
   stretches are one; the suffix array of the others and its common prefixes give the strings that
   occur again, and all but the earliest start is removable.
3. A minimizer with very many runs is dealt to several shards. What is first in its shard there is
   then compared between shards by a 128-bit hash of the string, in the order of the hashes.
4. The byte ranges of a document are united and cut out.

Tasks hold a shard or bucket of a size that the number of shards is chosen for, or stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.suffix_array import common_prefixes, suffix_array
from encore.session import materialise

LENGTH, GRAM = 100, 32
BUCKET_BYTES = 16 << 20  # of text whose minimizers meet in a bucket
SHARD_RUNS = 8192  # of stretches, in a shard; also those of a minimizer before it is split
FLUSH_RUNS = 1 << 19  # that a task gathers before it sends them on
SENT_ROWS = 20_000  # stretches in a batch
RUNS_AT_ONCE = 4096  # whose grams are compared in one step
SEPARATOR = b"\xff"  # in no UTF-8 text
LAST = 2**63 - 1  # place of rows without an id: after all others
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd numbers

RUN = [("hash", "<u8"), ("doc", "<i8"), ("content", "<i8"), ("start", "<i4"), ("run", "<i4"),
       ("sure", "<i4")]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of the ``gram`` bytes from each position; ``gram`` is a power of two."""
    value = (data.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    factor, width = MIXER, 1
    with np.errstate(over="ignore"):
        while width < gram:
            value = value[:-width] * factor + value[width:]
            factor, width = factor * factor, 2 * width
        value = (value ^ value >> np.uint64(32)) * MIXER
        return value ^ value >> np.uint64(29)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    least = values
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    count, shift = len(values) - width + 1, width - have
    return np.minimum(least[:count], least[shift:shift + count])


def stands_twice(
    grams: np.ndarray, width: int, least: np.ndarray, first: np.ndarray, size: np.ndarray,
) -> np.ndarray:
    """Whether the minimizing gram of a run stands at two or more places in the run's span.

    A string that starts twice in one run has it at two places at least. The leftmost is in the
    window of the run's first start, the rightmost in that of its last.
    """
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    twice = np.empty(len(first), np.int32)
    for a in range(0, len(first), RUNS_AT_ONCE):
        low, gram = first[a:a + RUNS_AT_ONCE], least[a:a + RUNS_AT_ONCE, None]
        high = low + size[a:a + RUNS_AT_ONCE] - 1
        left = low + (windows[low] == gram).argmax(axis=1)
        right = high + width - 1 - (windows[high] == gram)[:, ::-1].argmax(axis=1)
        twice[a:a + RUNS_AT_ONCE] = left != right
    return twice


def minimizer_runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimizer, first start, number of starts, sure) of the runs of a text's strings.

    ``sure`` is 1 where the run may repeat a string on its own, so that it has to be looked at even
    if its minimizer is at no other place.
    """
    if len(data) < length:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int32)] * 3)
    width = length - gram + 1
    grams = gram_hashes(np.frombuffer(data, np.uint8), gram)
    least = sliding_least(grams, width)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(least)))
    if size.max() > width:  # of a text that repeats itself; cut into bounded stretches
        pieces = -(-size // width)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + width * offset
        size = np.minimum(np.repeat(size, pieces) - width * offset, width)
    least = least[first]
    sure = stands_twice(grams, width, least, first, size)
    return least, first.astype(np.int32), size.astype(np.int32), sure


def known_repeats(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of minimizers that occur at two places or are marked, and a mask of all but the first
    of each.

    A place is a text and a start in it; of one place in copies of a text, the first document counts.
    """
    _, inverse, counts = np.unique(runs["hash"], return_inverse=True, return_counts=True)
    runs = runs[(counts[inverse] > 1) | (runs["sure"] > 0)]
    runs = runs[np.lexsort((runs["doc"], runs["start"], runs["content"], runs["hash"]))]
    if not len(runs):
        return runs, np.empty(0, bool)
    new_hash = np.concatenate(([True], runs["hash"][1:] != runs["hash"][:-1]))
    new_place = new_hash.copy()
    for column in ("content", "start"):
        new_place[1:] |= runs[column][1:] != runs[column][:-1]
    sure = runs["sure"]
    runs, new_hash = runs[new_place], new_hash[new_place]
    group = np.cumsum(new_hash) - 1
    # A place is marked if any of its rows was.
    place = np.cumsum(new_place) - 1
    marked = np.bincount(group[place], weights=sure)
    repeated = (np.bincount(group) > 1) | (marked > 0)
    kept = repeated[group]
    return runs[kept], ~new_hash[kept]


def send_runs(batches: Iterator[pa.RecordBatch], buckets: int, length: int, gram: int):
    """Blobs of runs by bucket of their minimizer, from (doc, content, text) rows.

    A minimizer that a task meets at several places is sent once, marked; its other places are known
    to repeat already, and go to buckets of their own kind that are spread by document.
    """
    gathered, texts, count = [], {}, 0

    def blobs():
        runs = np.concatenate(gathered) if gathered else np.empty(0, RUN)
        runs["doc"] = np.fromiter((texts[c] for c in runs["content"].tolist()), np.int64, len(runs))
        known, others = known_repeats(runs)
        single = runs[~np.isin(runs["hash"], known["hash"])]
        firsts = known[~others]
        firsts["sure"] = 1
        sent = np.concatenate((single, firsts))
        target = (sent["hash"] % np.uint64(buckets)).astype(np.int64)
        rest = known[others]
        for rows, at in ((sent, target), (rest, buckets + (rest["doc"] & 0x7FFFFFFF) % buckets)):
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
                columns = [rows[name][a:b].tobytes() for name, _ in RUN]
                yield int(at[a]), b"".join(columns), b - a

    def table(found):
        found = list(found)
        for a in range(0, len(found), 256):
            part = list(zip(*found[a:a + 256], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary()),
                 pa.array(part[2], pa.int64())], names=["bucket", "blob", "runs"])

    for batch in batches:
        for doc, content, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if content in texts:
                texts[content] = min(doc, texts[content])
                continue
            hashes, start, run, sure = minimizer_runs((text or "").encode(), length, gram)
            if not len(hashes):
                continue
            texts[content] = doc
            part = np.zeros(len(hashes), RUN)
            part["hash"], part["start"], part["run"], part["content"] = hashes, start, run, content
            part["sure"] = sure
            gathered.append(part)
            count += len(part)
        if count >= FLUSH_RUNS:
            yield from table(blobs())
            gathered, texts, count = [], {}, 0
    yield from table(blobs())


def read_blob(blob: bytes, count: int) -> np.ndarray:
    runs, at = np.empty(count, RUN), 0
    for name, kind in RUN:
        size = count * np.dtype(kind).itemsize
        runs[name] = np.frombuffer(blob[at:at + size], kind)
        at += size
    return runs


def bucket_repeats(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def find(table: pa.Table) -> pa.Table:
        blobs = zip(table.column("blob").to_pylist(), table.column("runs").to_pylist(), strict=True)
        runs = np.concatenate([read_blob(blob, count) for blob, count in blobs])
        if table.column("bucket")[0].as_py() < buckets:
            runs, _ = known_repeats(runs)
        return pa.table({
            "doc": runs["doc"], "content": runs["content"], "start": runs["start"],
            "run": runs["run"], "hash": runs["hash"].view(np.int64)})

    return find


def cut_stretches(batches: Iterator[pa.RecordBatch], length: int):
    """(shard, split, doc, content, start, stretch) from documents with their runs."""
    for batch in batches:
        found = batch.column(3)
        owner = np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy())
        runs = found.flatten()
        start, run = runs.field("start").to_numpy(), runs.field("run").to_numpy()
        for a in range(0, len(runs), SENT_ROWS):
            own, low = owner[a:a + SENT_ROWS], start[a:a + SENT_ROWS]
            high = low + run[a:a + SENT_ROWS] + (length - 1)
            edges = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
            stretches = []
            for x, y in zip(edges, [*edges[1:], len(own)], strict=True):
                data = batch.column(2)[int(own[x])].as_py().encode()  # one document at a time
                stretches += [data[i:j] for i, j in zip(low[x:y].tolist(), high[x:y].tolist(), strict=True)]
            sent = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [*(runs.field(name).slice(a, SENT_ROWS) for name in ("shard", "split")),
                 batch.column(0).take(sent), batch.column(1).take(sent), pa.array(low),
                 pa.array(stretches, pa.binary())],
                names=["shard", "split", "doc", "content", "start", "stretch"])


def spans_of(removable: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner, low, high): byte ranges of the strings that start at the given places of a text.

    No range goes over from one stretch of the text to the next; ``owner`` tells whose a place is.
    """
    own = owner[removable]
    new = np.ones(len(removable), bool)
    new[1:] = (own[1:] != own[:-1]) | (np.diff(removable) > length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(removable)) - 1
    return own[first], removable[first], removable[last[:len(first)]] + length


def shard_repeats(length: int) -> Callable[[pa.Table], pa.Table]:
    """Ranges to remove in a shard; of split minimizers also what is first here (with its hash)."""

    def find(table: pa.Table) -> pa.Table:
        doc, content, start = (table.column(c).to_numpy() for c in ("doc", "content", "start"))
        split = table.column("split").to_numpy(zero_copy_only=False)
        stretches = table.column("stretch").to_pylist()
        order = np.lexsort((start, content, doc)).tolist()  # earliest first
        found = []

        def add(at, low, high, hashes=None):
            at = np.asarray(at, np.int64)
            left, right = (None, None) if hashes is None else hashes.T
            columns = (doc[at], content[at], start[at] + low, start[at] + high, left, right)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            found.append(pa.table({
                name: pa.nulls(len(at), kind) if values is None else pa.array(values, kind)
                for name, values, kind in zip(
                    ("doc", "content", "low", "high", "left", "right"), columns, kinds, strict=True)}))

        earliest: dict[bytes, int] = {}
        first = np.array([earliest.setdefault(stretches[at], at) for at in order], np.int64)
        at = np.array(order, np.int64)
        later = (doc[first] != doc[at]) | (content[first] != content[at]) | (start[first] != start[at])
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        add(at[later], 0, lengths[at[later]])
        kept = np.fromiter(earliest.values(), np.int64, len(earliest))  # distinct stretches, earliest first
        sizes = lengths[kept] + 1
        edges = np.cumsum(sizes) - sizes
        text = np.frombuffer(SEPARATOR.join(stretches[at] for at in kept) + SEPARATOR, np.uint8)
        sa = suffix_array(text)
        cap = int(sizes.max()) + length
        shared = common_prefixes(text, sa, edges, cap)[sa]
        owner = np.repeat(np.arange(len(kept), dtype=np.int32), sizes)
        place = np.arange(len(text), dtype=np.int32) - edges.astype(np.int32)[owner]  # in its stretch
        whole = (place <= (lengths[kept] - length).astype(np.int32)[owner])[sa]
        # Neighbours in the array that share the length hold the same string.
        again = (shared >= length) & whole
        del shared
        group = np.cumsum(~again, dtype=np.int32) - np.int32(1)
        # What is earlier goes by document, then by place in it: stretches of one can overlap.
        at_doc = np.concatenate(([0], np.cumsum(
            (np.diff(doc[kept]) != 0) | (np.diff(content[kept]) != 0))))
        rank_of = ((at_doc << 32) + start[kept])[owner]
        rank_of += place
        rank_of = rank_of[sa]
        least = np.minimum.reduceat(rank_of, np.flatnonzero(~again))
        is_first = rank_of == least[group]
        del rank_of, group, least
        removable = np.zeros(len(text), bool)
        removable[sa[whole & ~is_first]] = True
        own, low, high = spans_of(np.flatnonzero(removable), owner, length)
        add(kept[own], low - edges[own], high - edges[own])
        hot = np.zeros(len(text), bool)
        hot[sa[whole & is_first]] = True
        hot &= split[kept][owner]
        hot = np.flatnonzero(hot)
        if len(hot):
            data = text.tobytes()
            digests = b"".join([xxhash.xxh3_128_digest(data[p:p + length]) for p in hot.tolist()])
            own, low = owner[hot], place[hot]
            add(kept[own], low, low + length, np.frombuffer(digests, "<i8").reshape(-1, 2))
        return pa.concat_tables(found)

    return find


def later_of_equal(batches: Iterator[pa.RecordBatch]):
    """All but the first row of equal (left, right), from rows in the order of these and place."""
    last, first = None, None
    for batch in batches:
        left, right, doc, content, low = (batch.column(i).to_numpy() for i in range(5))
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        if len(left):
            new[0] = (left[0], right[0]) != last
            group = np.cumsum(new)
            heads = np.flatnonzero(new)
            head = np.concatenate(([-1], heads))[group]
            same = np.zeros(len(left), bool)
            for column, k in ((doc, 0), (content, 1), (low, 2)):
                of_head = np.where(head >= 0, column[head], first[k] if first else 0)
                same |= column != of_head
            if len(heads):
                h = heads[-1]
                first = (doc[h], content[h], low[h])
            last = (left[-1], right[-1])
            yield batch.filter(pa.array(same)).select(["doc", "content", "low", "high"])


def united(spans: list) -> list[tuple[int, int]]:
    """Ranges as a sorted list without overlaps or touching neighbours."""
    merged: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    return [(a, b) for a, b in merged]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for low, high in spans:
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]])


class Keyed:
    """Documents with the keys that the steps go by."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str):
        self.text = F.coalesce(F.col(text_column), F.lit(""))
        self.doc = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST))
        self.content = F.xxhash64(self.text)
        self.docs, self.id = docs, id_column

    def keyed(self) -> DataFrame:
        return self.docs.select(
            self.doc.alias("doc"), self.content.alias("content"), self.text.alias("whole"))


def repeated_spans(source: Keyed, n_bytes: int, length: int, gram: int) -> DataFrame:
    """(doc, content, low, high) ranges to remove, overlapping, without copies of whole texts."""
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    sent = source.keyed().select("doc", "content", "whole").mapInArrow(
        lambda batches: send_runs(batches, buckets, length, gram),
        "bucket long, blob binary, runs long")
    runs = materialise(
        sent.groupBy("bucket").applyInArrow(
            bucket_repeats(buckets), "doc long, content long, start int, run int, hash long"),
        "repeat-runs")
    shards = max(1, -(-runs.count() // SHARD_RUNS))
    often = materialise(
        runs.groupBy("hash").count().filter(F.col("count") > SHARD_RUNS).select(
            "hash", F.ceil(F.col("count") / SHARD_RUNS).alias("parts")), "repeat-often")
    salt = F.when(F.col("parts").isNull(), 0).otherwise(
        F.pmod(F.xxhash64("doc", "content", "start"), F.col("parts")))  # also within a document
    dealt = runs.join(often, "hash", "left").select(
        "doc", "content", F.struct(
            "start", "run", F.pmod(F.xxhash64("hash", salt), F.lit(shards)).alias("shard"),
            F.col("parts").isNotNull().alias("split")).alias("r"))
    by_doc = dealt.groupBy("doc", "content").agg(F.collect_list("r").alias("found"))
    stretches = source.keyed().join(by_doc, ["doc", "content"]).select(
        "doc", "content", "whole", "found").mapInArrow(
        lambda batches: cut_stretches(batches, length),
        "shard long, split boolean, doc long, content long, start int, stretch binary")
    found = materialise(
        stretches.groupBy("shard").applyInArrow(
            shard_repeats(length),
            "doc long, content long, low int, high int, left long, right long"),
        "repeat-spans")
    firsts = found.filter("left is not null")
    order = ["left", "right", "doc", "content", "low"]
    across = firsts.repartition("left", "right").sortWithinPartitions(*order).select(
        *order, "high").mapInArrow(later_of_equal, "doc long, content long, low int, high int")
    return found.filter("left is null").select("doc", "content", "low", "high").unionByName(across)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id",
    text_column: str = "text", texts: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The steps' results: (id, doc, content, digest, n_bytes) of each row, the first document of
    each text (digest, first), and (doc, content, n_removed, n_spans, kept_sha256[, kept]) of the
    documents that lose a part."""
    source = Keyed(docs, id_column, text_column)
    base = materialise(
        docs.select(
            F.col(id_column).alias("id"), source.doc.alias("doc"), source.content.alias("content"),
            F.sha2(source.text.cast("binary"), 256).alias("digest"),
            F.octet_length(source.text).cast("long").alias("n_bytes")), "repeat-documents")
    # Stored, so that the join with it can be split where a text has very many copies.
    firsts = materialise(
        base.groupBy("digest").agg(F.min("doc").alias("first")), "repeat-firsts")
    n_bytes = base.agg(F.sum("n_bytes")).first()[0] or 0
    spans = repeated_spans(source, n_bytes, length, gram)
    by_doc = spans.groupBy("doc", "content").agg(
        F.collect_list(F.struct("low", "high")).alias("spans"))

    def apply(batches):
        for batch in batches:
            rows = []
            for doc, content, text, found in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                data, removed = text.encode(), united(found)
                kept = cut(data, removed)
                row = (doc, content, len(data) - len(kept), len(removed),
                       hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode(errors="ignore")) if texts else row)
            names = ["doc", "content", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    # Rows that repeat (same id, same text) are one document; one of them is cut.
    parts = source.keyed().join(by_doc, ["doc", "content"]).select(
        "doc", "content", "whole", "spans").mapInArrow(
        apply, "doc long, content long, n_removed long, n_spans long, kept_sha256 string"
        + ", kept string" * texts)
    parts = materialise(parts, "repeat-parts").dropDuplicates(["doc", "content"])
    return base, firsts, parts


def repeat_report(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Null texts are empty; texts shorter than ``length`` lose nothing. Rows without an id come after
    all others, in the order of a hash of their texts; rows of one id and text are one document and
    each gets its result. Other columns are not read, an empty table gives no rows.
    """
    base, firsts, parts = without_repeats(docs, length, gram, id_column, text_column)
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= length)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return base.join(firsts, "digest").join(parts, ["doc", "content"], "left").select(
        F.col("id").alias(id_column), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id",
    text_column: str = "text", drop_emptied: bool = False,
) -> DataFrame:
    """The documents with their repeated passages cut out, and all their columns.

    A character of which only a part is cut goes as a whole. Rows and null texts stay; with
    ``drop_emptied`` documents that have lost all their text go.
    """
    _, firsts, parts = without_repeats(docs, length, gram, id_column, text_column, texts=True)
    source = Keyed(docs, id_column, text_column)
    marked = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), source.doc.alias("doc"),
        source.content.alias("content"),
        F.sha2(source.text.cast("binary"), 256).alias("digest"),
        F.octet_length(source.text).alias("n_bytes"))
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= length)
    text = F.when(copy, "").otherwise(F.coalesce("kept", f"row.{text_column}"))
    found = marked.join(firsts, "digest").join(
        parts.select("doc", "content", "kept"), ["doc", "content"], "left")
    if drop_emptied:
        found = found.filter((F.col("n_bytes") == 0) | (F.coalesce(text, F.lit("")) != ""))
    return found.select(
        *[(text if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
