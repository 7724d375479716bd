"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: A code is the vector's signs; neighbours by Hamming distance and then id.
TOPK = """
WITH codes AS (
  SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN embedding[i] > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END))::UBIGINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), near AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
  FROM codes q JOIN codes r ON r.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM near
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Every run of words of a window's size is compared with the windows as a string.
CONTAMINATION = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
  FROM doc, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS u(i)
),
hits AS (SELECT runs.r, runs.i, runs.size, windows.item_id FROM runs JOIN windows ON runs.size = windows.size AND runs.s = windows.s),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AND 20 * coalesce(places.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

#: All orders of the five filters, applied to the counts of failure masks.
FILTER_AUDIT = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc.doc_id > min(doc.doc_id) OVER (PARTITION BY text), false) AS e
  FROM doc LEFT JOIN judged ON doc.doc_id = judged.doc_id
),
masks AS (SELECT part, concat_ws('', CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS mask,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, i::INTEGER AS step, filter_order[i] AS f, filter_order[1:i - 1] AS before FROM orders, range(1, 6) AS r(i)),
out AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(mask, before || f, '') = mask THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') = mask THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') <> mask THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') = mask THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') = mask THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM out
"""

#: Rows are told apart by their numbers; all scores are computed.
HARD_NEGATIVES = """
WITH base AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM base a JOIN base b ON a.r <> b.r WHERE a.vec_id % 100 = 0
),
positive AS (SELECT a, b, anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id))::INTEGER AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
  FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLE_SQL = {"op3_topk": TOPK, "op9_decontaminate": CONTAMINATION, "op11_filter_audit": FILTER_AUDIT, "op12_hard_negatives": HARD_NEGATIVES}
