"""Benchmark contamination by winnowed fingerprints, with built-in functions only.

Documents and benchmark items are winnowed alike: of the hashes of all ``gram``-word runs, the least
one in each window of neighbouring runs is kept with its place. Any span of ``window`` words that two
texts share holds a kept run at the same place in both, so joining the kept hashes finds every shared
span. A match gives an alignment of a document with an item; alignments are extended by comparing
the words themselves, and only windows that are equal word by word count. Items shorter than a
window are looked up by the hash of the whole item instead, and verified like the others.

Only hashes are shuffled before candidates are known. Equal texts share a key, so copies of a
document are matched and verified once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import LOWER, UPPER, WORD_BYTES, unused
from encore.session import materialise

WINDOW, GRAM = 13, 5
PLACE_BITS = 24  # of a kept value; the other 40 bits are the hash
SEPARATORS = "".join(chr(b) for b in range(128) if WORD_BYTES[b] == 32)
SEGMENT = 1 << 20  # words of a text that are winnowed together


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Separators become blanks and A-Z lower case in one pass, so a plain split does the rest."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def upto(last: Column) -> Column:
    """0 .. last, empty if there is none."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(
        F.array().cast("array<int>"))


def text_key(text: Column) -> Column:
    """Equal for equal texts; 128 bits of two hashes and the length tell others apart."""
    text = F.coalesce(text, F.lit(""))
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.hash(text)), F.octet_length(text))


def gram_hashes(words: Column, size: int) -> Column:
    return F.transform(
        upto(F.size(words) - size), lambda i: F.xxhash64(F.slice(words, i + 1, size)))


def winnowed(words: Column, window: int, gram: int) -> Column:
    """Kept runs of a word list: hash in the upper bits, place in the lower ones.

    Within a window the least hash wins, the first of equals.
    """
    runs = window - gram + 1

    def value(i: Column) -> Column:
        hashed = F.xxhash64(*[words[i + k] for k in range(gram)])
        return F.shiftleft(F.shiftright(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    def kept(values: Column) -> Column:
        def least(i: Column) -> Column:
            near = [values[i + k] for k in range(runs)]
            return F.least(*near) if runs > 1 else near[0]

        return F.array_distinct(F.transform(upto(F.size(values) - runs), least))

    return let(F.transform(upto(F.size(words) - gram), value), kept)


def fingerprints(words: Column, window: int, gram: int) -> Column:
    """(segment, values) of a word list, segments overlapping so that no window is cut."""
    step = SEGMENT - window + 1
    return F.transform(
        upto(F.ceil((F.size(words) - window + 1) / step).cast("int") - 1),
        lambda s: F.struct(
            (s * step).alias("first"),
            let(F.slice(words, s * step + 1, SEGMENT), lambda w: winnowed(w, window, gram))
            .alias("values")))


def exploded(rows: DataFrame, key: str) -> DataFrame:
    """(key, hash, place) rows of a table with fingerprints."""
    value = F.col("value")
    return rows.select(key, F.explode("fingerprints").alias("f")).select(
        key, F.col("f.first").alias("first"), F.explode("f.values").alias("value")
    ).select(
        key, F.shiftright(value, PLACE_BITS).alias("hash"),
        (value.bitwiseAND((1 << PLACE_BITS) - 1).cast("int") + F.col("first")).alias("place"))


def item_classes(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(class, item_words, items): items of the same words are one class; wordless ones are none."""
    listed = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"),
        words(F.col(text_column)).alias("item_words"),
    ).filter(F.size("item_words") > 0)
    return listed.groupBy("item_words").agg(F.collect_set("item").alias("items")).select(
        F.md5(F.array_join("item_words", " ")).alias("class"), "item_words", "items")


def covered(equal: Column, window: Column) -> Column:
    """Places that lie in a run of at least ``window`` true values."""

    def starts(flags: Column) -> Column:
        return F.transform(
            upto(F.size(flags) - window),
            lambda s: F.forall(F.slice(flags, s + 1, window), lambda x: x))

    def places(flags: Column, start: Column) -> Column:
        return F.filter(
            upto(F.size(flags) - 1),
            lambda j: F.exists(
                F.slice(start, F.greatest(F.lit(1), j - window + 2),
                        F.least(j + 1, window)), lambda s: s))

    return let(equal, lambda flags: let(starts(flags), lambda s: places(flags, s)))


def whole_item_hits(docs: DataFrame, classes: DataFrame, text: Column, size: int) -> DataFrame:
    """(key, class, shift) where a text has the hash of a whole item of ``size`` words."""
    hashed = docs.select(text_key(text).alias("key"), F.posexplode(
        let(words(text), lambda w: gram_hashes(w, size))).alias("shift", "hash"))
    items = classes.filter(F.size("item_words") == size).select(
        "class", F.xxhash64("item_words").alias("hash"))
    return hashed.join(items, "hash").select("key", "class", "shift")


def measured(
    docs: DataFrame, benchmark: DataFrame, window: int, gram: int, columns: dict[str, str],
) -> tuple[DataFrame, DataFrame]:
    """(id, key, n_words) of each row, and (key, n_hit, items) of each text with hits."""
    text = F.col(columns["text"])
    prepared = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        fingerprints(w, window, gram).alias("fingerprints")))
    base = materialise(
        docs.select(F.col(columns["id"]).alias("id"), text_key(text).alias("key"),
                    prepared.alias("p")).select("id", "key", "p.n_words", "p.fingerprints"),
        "contamination-documents")
    classes = materialise(
        item_classes(benchmark, columns["item_id"], columns["item_text"]), "contamination-items")
    item_size = F.size("item_words")

    long_items = materialise(exploded(
        classes.filter(item_size >= window).select(
            "class", let(F.col("item_words"), lambda w: fingerprints(w, window, gram))
            .alias("fingerprints")), "class",
    ).select("class", "hash", F.col("place").alias("item_place")), "contamination-prints")
    found = exploded(base, "key").join(long_items, "hash").select(
        "key", "class", (F.col("place") - F.col("item_place")).alias("shift"))
    shorter = [row[0] for row in classes.filter(item_size < window).select(
        item_size).distinct().collect()]  # fewer than ``window`` values
    for size in sorted(shorter):
        found = found.unionByName(whole_item_hits(docs, classes, text, size))
    found = materialise(found.distinct(), "contamination-candidates")

    # Words of candidate documents, once for each text; then of each alignment the words it covers.
    wanted = materialise(
        found.join(classes.select("class", item_size.alias("n")), "class").groupBy("key").agg(
            F.collect_list(F.struct("class", "shift", "n")).alias("found")),
        "contamination-alignments")
    texts = docs.select(text_key(text).alias("key"), text.alias("whole")).join(
        wanted.select("key"), "key", "left_semi").groupBy("key").agg(
        F.any_value("whole").alias("whole"))
    aligned = texts.join(wanted, "key").select("key", F.explode(let(
        words(F.col("whole")), lambda w: F.transform("found", lambda f: F.struct(
            f["class"].alias("class"), f["shift"].alias("shift"),
            F.transform(upto(f["n"] - 1), lambda j: F.get(w, f["shift"] + j)).alias("words")))
    )).alias("a")).select("key", "a.*")
    equal = F.zip_with("words", "item_words", lambda a, b: F.coalesce(a == b, F.lit(False)))
    hits = materialise(
        aligned.join(classes, "class").select(
            "key", "class", "items", "shift",
            covered(equal, F.least(F.lit(window), item_size)).alias("places"),
        ).filter(F.size("places") > 0), "contamination-hits")
    n_hit = hits.select(
        "key", F.explode(F.transform("places", lambda j: j + F.col("shift"))).alias("place")
    ).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    listed = hits.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    return base.select("id", "key", "n_words"), materialise(
        n_hit.join(listed, "key"), "contamination-texts")


def is_contaminated(words_per_hit: int) -> Column:
    hit = F.coalesce("n_hit", F.lit(0))
    return (hit > 0) & (hit * words_per_hit >= F.col("n_words"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
    words_per_hit: int = 20, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated`` (a word hit, and at least one of ``words_per_hit``).

    Null, empty and wordless texts have no words and no hits (hash of the empty string); wordless
    items match nothing; a null item id is listed as ``null``; items of one id count once. Null ids
    stay null, repeated rows are returned each, other columns are not read. An empty benchmark or
    empty documents give no hits or no rows.
    """
    columns = {"id": id_column, "text": text_column, "item_id": item_id_column,
               "item_text": item_text_column}
    base, per_text = measured(docs, benchmark, window, gram, columns)
    return base.join(per_text, "key", "left").select(
        F.col("id").alias(id_column), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256)
        .alias("items_sha256"), is_contaminated(words_per_hit).alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
    words_per_hit: int = 20, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """The rows whose text is not contaminated, with all their columns, whatever their names.

    Null, empty and wordless texts stay, null ids are kept like others, rows of one text stay or go
    together. An empty benchmark keeps all rows, an empty table gives none.
    """
    columns = {"id": id_column, "text": text_column, "item_id": item_id_column,
               "item_text": item_text_column}
    base, per_text = measured(docs, benchmark, window, gram, columns)
    bad_key = unused(docs, "contaminated_key")
    bad = materialise(
        base.join(per_text, "key").filter(is_contaminated(words_per_hit)).select(
            F.col("key").alias(bad_key)).distinct(), "contaminated-texts")
    return docs.join(bad, text_key(F.col(text_column)) == F.col(bad_key), "left_anti")
