"""DuckDB SQL for conformance, style and reading rules, over any table of elements.

``{t}`` stands for the table. Ancestors are pairs of rows without a row between
them that closes the upper one, written out as it is defined.
"""

from __future__ import annotations

from folia.vocabulary import ALL_TYPES, CONTAINER_TYPES, CONTENTLESS_TYPES, ENCODINGS


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_ROWS = """
t AS (
  SELECT *, coalesce(level, 1) AS lv, coalesce(kind, '') AS k, coalesce(element_type, '') AS et, coalesce(content, '') AS c, coalesce(element_order, -1) AS o, coalesce(element_order, 0) AS o0
  FROM {t}
),
anc AS (
  SELECT x.conv_id, x.pos, r.pos AS rpos, r.k AS rk, r.et AS ret
  FROM t x JOIN t r ON r.conv_id = x.conv_id AND r.pos < x.pos AND r.lv < x.lv
  WHERE NOT EXISTS (SELECT 1 FROM t m WHERE m.conv_id = x.conv_id AND m.pos > r.pos AND m.pos < x.pos AND m.lv <= r.lv)
)"""

_VALIDATE = f"""{_ROWS},
roots AS (SELECT * FROM t WHERE k = 'value' AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.conv_id = t.conv_id AND anc.pos = t.pos AND rk = 'value')),
last_root AS (SELECT t.conv_id, t.pos, max(r.pos) AS rpos FROM t JOIN roots r ON r.conv_id = t.conv_id AND r.pos < t.pos GROUP BY ALL),
w AS (
  SELECT *, row_number() OVER d AS n, lag(o) OVER d AS before_o, row_number() OVER (PARTITION BY conv_id, element_order ORDER BY pos) AS nth, min(lv) OVER (PARTITION BY conv_id) AS least,
    (SELECT arg_max(p.level, p.pos) FROM t p WHERE p.conv_id = t.conv_id AND p.pos < t.pos AND p.level IS NOT NULL) AS before_level,
    k = 'block' AND et = 'document' AND coalesce(level = 0, false) AS root
  FROM t WINDOW d AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT conv_id, element_order_ AS element_order, rule, field FROM (
  SELECT conv_id, o AS element_order_, 'V1' AS rule, 'level' AS field FROM w WHERE level IS NULL
  UNION ALL SELECT conv_id, o, 'V2', 'level' FROM w WHERE level < 1 AND NOT root
  UNION ALL SELECT conv_id, o, 'V3', 'level' FROM w WHERE level IS NOT NULL AND (level >= 1 OR root) AND before_level > 0 AND level > before_level + 1
  UNION ALL SELECT conv_id, o, 'V4', 'content' FROM w WHERE root AND c <> ''
  UNION ALL SELECT conv_id, o, 'V5', 'kind' FROM w WHERE k NOT IN ('', 'block', 'inline', 'value')
  UNION ALL SELECT conv_id, o, 'V6', 'element_type' FROM w WHERE et = ''
  UNION ALL SELECT conv_id, o, 'V7', 'encoding' FROM w WHERE encoding <> '' AND encoding NOT IN {_in(ENCODINGS)}
  UNION ALL SELECT conv_id, o, 'V8', 'element_order' FROM w WHERE o < 0
  UNION ALL SELECT conv_id, o, 'V9', 'element_order' FROM w WHERE element_order >= 0 AND nth > 1
  UNION ALL SELECT conv_id, o, 'L1', 'list' FROM w WHERE CASE WHEN n = 1 THEN o <> 0 ELSE o <> before_o + 1 END
  UNION ALL SELECT conv_id, arg_min(o, lv * 100000 + pos), 'L2', 'list' FROM w GROUP BY conv_id HAVING min(lv) > 1
  UNION ALL SELECT conv_id, o, 'L4', 'list' FROM w WHERE k = 'block' AND et = 'list_item' AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.conv_id = w.conv_id AND a.pos = w.pos AND rk = 'block' AND ret IN ('list', 'deflist'))
  UNION ALL SELECT conv_id, o, 'L4', 'list' FROM w WHERE k = 'block' AND et = 'caption' AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.conv_id = w.conv_id AND a.pos = w.pos AND rk = 'block' AND ret IN ('figure', 'table'))
  UNION ALL SELECT conv_id, o, 'L5', 'list' FROM w WHERE k = 'inline' AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.conv_id = w.conv_id AND a.pos = w.pos AND rk <> 'inline')
  UNION ALL SELECT w.conv_id, w.o, 'L6', 'list' FROM w JOIN last_root l ON l.conv_id = w.conv_id AND l.pos = w.pos JOIN t r ON r.conv_id = l.conv_id AND r.pos = l.rpos
    WHERE w.k = 'inline' AND w.lv = r.lv AND NOT EXISTS (SELECT 1 FROM t m WHERE m.conv_id = w.conv_id AND m.pos > r.pos AND m.pos < w.pos AND m.lv <= r.lv)
)"""

_ATTR = "regexp_extract(attributes, '{k}=([^;]*)', 1)"
_RANK = f"coalesce(try_cast({_ATTR.replace('{k}', 'heading_level')} AS INTEGER), level, 1)"

_LINT = f"""{_ROWS},
w AS (
  SELECT *, lead(lv) OVER d AS nxt, lag(k) OVER d AS before_k, lag(c) OVER d AS before_c, lag(level) OVER d AS before_level, lag(o0) OVER d AS before_o,
    (SELECT arg_min(b.lv, b.pos) FROM t b WHERE b.conv_id = t.conv_id AND b.pos > t.pos AND b.k = 'block') AS next_block,
    (SELECT arg_min(b.k || b.lv, b.pos) FROM t b WHERE b.conv_id = t.conv_id AND b.pos > t.pos AND b.lv <= t.lv) AS beside,
    (SELECT arg_max(a.rk, a.rpos) FROM anc a WHERE a.conv_id = t.conv_id AND a.pos = t.pos) AS parent_k,
    (SELECT arg_max({_RANK}, h.pos) FROM t h WHERE h.conv_id = t.conv_id AND h.pos < t.pos AND h.et = 'heading') AS before_rank,
    min(CASE WHEN k = 'value' THEN o0 END) OVER (PARTITION BY conv_id) AS first_value,
    min(CASE WHEN k = 'block' AND level = 1 AND et <> 'metadata' THEN o0 END) OVER (PARTITION BY conv_id) AS first_body,
    k = 'block' AND c = '' AND et IN {_in(CONTAINER_TYPES)} AS container, {_RANK} AS rank
  FROM t WINDOW d AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT conv_id, o0 AS element_order, rule, severity FROM (
  SELECT conv_id, o0, 'empty_element' AS rule, 'info' AS severity FROM w WHERE c = '' AND et <> '' AND et NOT IN {_in(CONTENTLESS_TYPES)} AND (nxt IS NULL OR nxt <= lv) AND NOT (container AND nxt IS NOT NULL)
  UNION ALL SELECT conv_id, o0, 'childless_container', 'warning' FROM w WHERE container AND next_block <= lv
  UNION ALL SELECT conv_id, o0, 'block_in_inline', 'warning' FROM w WHERE k = 'block' AND parent_k = 'inline'
  UNION ALL SELECT conv_id, o0, 'rank_skipped', 'warning' FROM w WHERE et = 'heading' AND before_rank > 0 AND rank > before_rank + 1
  UNION ALL SELECT conv_id, o0, 'rank_missing', 'warning' FROM w WHERE et = 'heading' AND {_ATTR.replace('{k}', 'heading_level')} = ''
  UNION ALL SELECT conv_id, o0, 'generic_source', 'warning' FROM w WHERE et = 'generic' AND {_ATTR.replace('{k}', 'source_type')} = ''
  UNION ALL SELECT conv_id, o0, 'lone_plain', 'warning' FROM w WHERE et = 'plain' AND k = 'block' AND level > 1 AND before_k = 'block' AND before_c = '' AND before_level = level - 1 AND coalesce(beside, '') <> 'block' || level
  UNION ALL SELECT conv_id, o0, 'unknown_type', 'warning' FROM w WHERE et <> '' AND et NOT IN {_in(ALL_TYPES)}
  UNION ALL SELECT conv_id, o0, 'table_schema', 'warning' FROM w WHERE et = 'table' AND c <> '' AND NOT contains(c, '"headers"')
  UNION ALL SELECT conv_id, o0, 'list_content', 'warning' FROM w WHERE et = 'list' AND c <> ''
  UNION ALL SELECT conv_id, o0, 'deflist', 'warning' FROM w WHERE et = 'deflist'
  UNION ALL SELECT conv_id, o0, 'code_language', 'info' FROM w WHERE et = 'code' AND {_ATTR.replace('{k}', 'language')} = ''
  UNION ALL SELECT conv_id, o0, 'order_gap', 'info' FROM w WHERE before_o >= 0 AND o0 > before_o + 10
  UNION ALL SELECT conv_id, o0, 'late_frontmatter', 'warning' FROM w WHERE et = 'metadata' AND {_ATTR.replace('{k}', 'role')} = 'frontmatter' AND first_body < o0
  UNION ALL SELECT conv_id, o0, 'block_after_value', 'warning' FROM w WHERE k = 'block' AND coalesce(level, 0) = 1 AND first_value < o0
)"""

_QUALITY = f"""{_ROWS},
h AS (
  SELECT *, try_cast({_ATTR.replace('{k}', 'heading_level')} AS INTEGER) AS hl,
    (SELECT arg_min(x.et, x.element_order * 100000 + x.pos) FROM t x WHERE x.conv_id = t.conv_id AND x.element_order > t.element_order) AS next_et,
    (SELECT arg_min(coalesce(try_cast({_ATTR.replace('{k}', 'heading_level').replace('attributes', 'x.attributes')} AS INTEGER), 99), x.element_order * 100000 + x.pos) FROM t x WHERE x.conv_id = t.conv_id AND x.element_order > t.element_order) AS next_hl,
    (SELECT min(x.element_order) FROM t x WHERE x.conv_id = t.conv_id AND x.element_order > t.element_order AND x.level <= t.level) AS closed
  FROM t
)
SELECT conv_id, element_order, 'empty_section' AS rule FROM h WHERE et = 'heading' AND next_et = 'heading' AND next_hl <= hl
UNION ALL SELECT conv_id, min(element_order), 'duplicate_heading' FROM h WHERE et = 'heading' AND c <> '' GROUP BY conv_id, c, hl HAVING count(*) > 1
UNION ALL SELECT conv_id, element_order, 'link_without_text' FROM h WHERE et = 'link' AND c = ''
  AND NOT EXISTS (SELECT 1 FROM t x WHERE x.conv_id = h.conv_id AND x.element_order > h.element_order AND x.level > h.level AND x.element_order < coalesce(h.closed, 2147483647))"""


def validate(table: str) -> str:
    return _VALIDATE.replace("{t}", table)


def lint(table: str) -> str:
    return _LINT.replace("{t}", table)


def quality(table: str) -> str:
    return _QUALITY.replace("{t}", table)
