"""Best-fit packing of documents into training sequences, under conflicts.

Documents longer than a sequence are cut into whole sequences and a rest. Rests are packed longest
first: bins are kept in the order of their residual space and carry a bitmap of the sources and
one of the duplicate clusters they hold. From the tightest bin that has room, the search goes on to
the next larger residual until a bin without conflict is found; if there is none, a bin is opened.

Documents are dealt over shards by a hash, so each shard is a fair sample of all sources and
clusters whatever their sizes, and has a bounded number of documents. Only sizes and keys are
shuffled, no text.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.session import materialise

SHARD_DOCUMENTS = 4096  # packed by one call; a shard's size is spread closely about it
COPIES = 65_536  # equal rows that one task numbers at a time


class Bins:
    """Open bins of one shard, ordered by residual space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest bin that takes it; return the bin and the offset.

        ``source`` and ``cluster`` are bitmaps of one bit, or 0 where they conflict with nothing.
        """
        order, sources, clusters = self.order, self.sources, self.clusters
        at = bisect_left(order, (size, -1))
        while at < len(order) and (
            sources[order[at][1]] & source or clusters[order[at][1]] & cluster
        ):
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
        else:
            residual, number = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= source
        clusters[number] |= cluster
        if residual > size:
            insort(order, (residual - size, number))
        return number, self.capacity - residual


def bitmaps(values: pd.Series) -> list[int]:
    """A bit for each distinct value; null has none."""
    codes, _ = pd.factorize(values)
    return [1 << int(code) if code >= 0 else 0 for code in codes]


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of one shard's pieces: (piece rows, longest first) -> bin, offset."""
    pieces = pieces.sort_values(
        ["size", "id", "piece", "source", "cluster"], ascending=[False, True, True, True, True],
        kind="stable")
    bins = Bins(capacity)
    placed = [
        bins.place(size, source, cluster)
        for size, source, cluster in zip(
            pieces["size"].tolist(), bitmaps(pieces["source"]), bitmaps(pieces["cluster"]),
            strict=True)
    ]
    pieces["bin"] = [number for number, _ in placed]
    pieces["bin_offset"] = [offset for _, offset in placed]
    return pieces


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with a ``number`` that tells equal ones apart, whatever the layout of the input.

    Equal rows are counted and dealt out again, in spans that spread over tasks: no window over a
    group of copies is needed.
    """
    columns = rows.columns
    spans = rows.groupBy(*columns).agg(F.count("*").alias("copies")).select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("span"))
    first = F.col("span") * COPIES
    return spans.repartition(*columns, "span").select(
        *columns, F.explode(F.sequence(first, F.least(first + COPIES, "copies") - 1)).alias("number"))


def pack(
    docs: DataFrame, size: Column, cluster: Column, capacity: int = 2048, id_column: str = "doc_id",
    source_column: str = "source", shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``n_tokens``, ``bin_id``, ``bin_offset``.

    ``size`` gives a document's tokens, ``cluster`` its duplicate cluster. ``start`` is the piece's
    first token within the document. A bin holds no two pieces of one source or of one cluster; a
    piece that fills its bin meets nothing. A null source or cluster conflicts with nothing.
    Documents of null or no size take no room: one row with null bin and offset. Null ids are
    packed like others, repeated rows each on their own, other columns are not read. Bins do not
    depend on the order or the files of the rows.
    """
    sized = materialise(
        numbered(docs.select(
            F.col(id_column).alias("id"), F.col(source_column).alias("source"),
            cluster.alias("cluster"), F.coalesce(size, F.lit(0)).cast("int").alias("total"),
        )), "pack-sizes",
    )
    shards = max(1, -(-sized.count() // shard_documents))
    place = F.xxhash64("id", "source", "cluster", "total", "number")
    whole = F.floor(F.col("total") / capacity).cast("int")
    pieces = sized.select(
        "*", F.pmod(place, F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), whole)).alias("piece"),
    ).select(
        "*", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).alias("size"),
    ).filter((F.col("size") > 0) | (F.col("total") <= 0))
    kind = sized.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start int, size int, shard long, bin int, bin_offset int"
    columns = ["id", "piece", "start", "size", "shard", "bin", "bin_offset"]
    open_pieces = pieces.filter(F.col("size").between(1, capacity - 1))
    packed = open_pieces.select(
        "id", "piece", "start", "size", "source", "cluster", "shard"
    ).groupBy("shard").applyInPandas(lambda group: pack_shard(group, capacity)[columns], schema)
    # Whole sequences are bins of their own, told apart by document and piece.
    own = pieces.filter(F.col("size") == capacity).select("id", "piece", "start", "size")
    none = pieces.filter(F.col("size") <= 0).select("id", "piece", "start", "size")
    named = packed.withColumn(
        "bin_id", F.concat_ws("-", F.col("shard").cast("string"), F.col("bin").cast("string"))
    ).select("id", "piece", "start", "size", "bin_id", "bin_offset").unionByName(
        own.withColumns({
            "bin_id": F.concat(F.lit("whole-"), F.coalesce(F.col("id").cast("string"), F.lit("null")),
                               F.lit("-"), F.col("piece").cast("string")),
            "bin_offset": F.lit(0)})
    ).unionByName(none.withColumns({
        "bin_id": F.lit(None).cast("string"), "bin_offset": F.lit(None).cast("int")}))
    return named.select(
        F.col("id").alias(id_column), "piece", "start", F.col("size").alias("n_tokens"),
        "bin_id", "bin_offset",
    )


def token_estimate(text: Column, bytes_per_token: int = 4) -> Column:
    """Tokens of a text, taken from its bytes; exact counts can be given instead."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / bytes_per_token).cast("int")


def copy_cluster(text: Column) -> Column:
    """Cluster of a text: all texts that are equal without case and blanks; null if blank."""
    plain = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.when(F.length(plain) > 0, F.xxhash64(plain))
