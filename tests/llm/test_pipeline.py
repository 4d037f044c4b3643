import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain as plain_contamination
from test_repeats import plain as plain_repeats
from test_simhash import plain_components, plain_fingerprint

from encore.llm import simhash
from encore.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, each reading what the one before has stored."""
    docs = table(spark, SF_DIR, "documents")
    found = [("documents", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF_DIR), f"test-{name}")
        found.append((name, docs.columns, docs.collect()))
    return found


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns_and_names(stages):
    assert [name for name, _, _ in stages[1:]] == [
        "quality", "near_dedup", "repeats", "decontaminate", "pack"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[1:-1])


def test_quality_keeps_rows_as_they_are(stages):
    before, after = texts(stages[0][2]), texts(stages[1][2])
    assert 0.5 * len(before) < len(after) < len(before)
    assert all(before[i] == t for i, t in after.items())


def test_stages_against_brute_force(spark, stages):
    rows = [(r.doc_id, r.text) for r in stages[1][2]]
    component = plain_components(rows, 2)
    wanted = {i for i, t in rows if component[plain_fingerprint(t)] == i}
    assert set(texts(stages[2][2])) == wanted and len(wanted) < len(rows)

    rows = [(r.doc_id, r.text) for r in stages[2][2]]
    cut = plain_repeats(rows, 100)
    wanted = {i: cut[i, t or ""][4].decode(errors="ignore") for i, t in rows}
    wanted = {i: t for i, t in wanted.items() if t or not dict(rows)[i]}
    assert {i: t or "" for i, t in texts(stages[3][2]).items()} == wanted
    assert all(r.n_chars == len(r.text) for r in stages[3][2] if r.text)

    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in stages[3][2]]
    wanted = {row[0] for row in plain_contamination(rows, items) if not row[5]}
    assert set(texts(stages[4][2])) == wanted and len(wanted) < len(rows)

    sizes = {r.doc_id: -(-len((r.text or "").encode()) // 4) for r in stages[4][2]}
    packed, bins = {}, {}
    for r in stages[5][2]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
    assert packed == sizes and max(bins.values()) <= 2048


def test_run_and_entry(spark, stages):
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(stages[-1][2])
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(
        any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_first_of_each_component(spark):
    rows = [(5, "a b c d", 1), (3, "a b c d", 2), (3, "a b c d", 3), (None, "a b c d", 4),
            (None, "only here and nowhere else", 5), (None, "only here and nowhere else", 6), (9, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_id int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted(
        [(3, "a b c d"), (None, "only here and nowhere else"), (9, None)], key=str)
    assert simhash.keep_first(docs.limit(0)).count() == 0


def odd_documents(spark):
    """Documents with every odd row, and columns named like those that the stages make."""
    docs = table(spark, SF_DIR, "documents").limit(60)
    schema = docs.schema
    passage = " ".join(f"word{k}" for k in range(60))
    item = table(spark, SF_DIR, "benchmark").filter("length(text) > 200").first().text
    texts = [(None, None), (7_000_001, None), (7_000_002, ""), (7_000_003, " \t\n"), (None, "no id here"),
             (7_000_004, "long " * 60_000), (7_000_005, f"first {passage}"),
             (7_000_006, f"second one {passage} goes on"), (7_000_007, item), (None, item)]
    rows = [tuple(i if f.name == "doc_id" else t if f.name == "text" else None for f in schema)
            for i, t in [*texts, *texts[:4], texts[5]]]
    docs = docs.unionByName(spark.createDataFrame(rows, schema))
    clashes = ["id", "doc", "content", "digest", "kept", "row", "key", "score", "label", "fingerprint",
               "component", "bin_id", "cluster", "size", "total", "number", "n_bytes", "spans"]
    return docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(clashes)])


def test_odd_rows_through_every_stage(spark):
    docs = corpus_pipeline.materialise(odd_documents(spark), "odd")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF_DIR), f"odd-{name}")
        kept[name] = docs.collect()
        assert all(r.n_bytes == 16 and r["id"] == 0 for r in kept[name])
    near = [r.doc_id for r in kept["near_dedup"]]
    assert len(near) == len(set(near)) + near.count(None) - (None in near)
    # Texts without words link like any other: one of all of them stays.
    assert sum(not (r.text or "").strip() for r in kept["near_dedup"]) == 1
    cut = texts(kept["repeats"])
    assert "word59" in cut[7_000_005] and "word30" not in cut[7_000_006]
    assert "second one" in cut[7_000_006] and "goes on" in cut[7_000_006]
    assert len(cut[7_000_004]) < 200 and 7_000_007 not in texts(kept["decontaminate"])
    packed = corpus_pipeline.pack(spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept["decontaminate"]}
    good = corpus_pipeline.keep_good(spark, odd_documents(spark), SF_DIR)
    assert good.columns == docs.columns and good.filter("n_bytes <> 16").isEmpty()


def test_empty_documents_through_every_stage(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF_DIR)
        assert found.isEmpty()
        if name != "pack":
            assert found.columns == docs.columns
