"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

CONTAMINATION = f"""
WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark),
item_window AS (
    SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS gram
    FROM (SELECT *, least(13, len(w)) AS size FROM item WHERE len(w) > 0),
         unnest(range(1, len(w) - size + 2)) AS u(s)
),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
doc_window AS (
    SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS gram
    FROM doc, (SELECT DISTINCT size FROM item_window) AS sizes,
         unnest(range(1, len(w) - size + 2)) AS u(s)
),
hit AS (SELECT doc_id, s, size, item_id FROM doc_window JOIN item_window USING (size, gram)),
places AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + size)) AS u(p)
    GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE vec AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fit AS (
    SELECT * FROM vec
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0
),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
reach AS (
    SELECT vec_id AS node, vec_id AS other FROM vec
    UNION SELECT node, b FROM reach JOIN link ON other = a
),
component AS (SELECT node AS vec_id, min(other) AS component_id FROM reach GROUP BY node),
links AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN links USING (vec_id)
"""

HARD_NEGATIVES = """
WITH vec AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
numbered AS (SELECT *, row_number() OVER () AS r FROM vec),
pair AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM numbered a JOIN numbered b ON a.r <> b.r AND len(a.q) = len(b.q)
    WHERE a.vec_id % 50 = 0
),
positive AS (
    SELECT a, anchor_id, other_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id NULLS LAST) AS place
    FROM pair WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, place ORDER BY score DESC, other_id NULLS LAST) AS INTEGER)
           AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN pair n ON n.a = p.a AND NOT n.same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE_SQL = {
    "op3_benchmark_decontamination": CONTAMINATION,
    "op9_embedding_near_dedup": NEAR_VECTORS,
    "op13_hard_negatives": HARD_NEGATIVES,
}
