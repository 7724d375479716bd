"""DuckDB SQL for the registered queries: the same elements, made and worked on in SQL."""

from __future__ import annotations

from folia.plans import oracle_rules
from folia.sources.conversations import IRREGULAR, SHAPES


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


FLAT = """
ln AS (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS sub FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations)),
raw AS (
  SELECT conv_id, turn, 0::BIGINT AS sub, 'heading' AS element_type, role || ' ' || turn AS content, 'heading_level=' || (1 + turn % 3) AS attributes FROM conversations
  UNION ALL
  SELECT conv_id, turn, sub, CASE WHEN sub % 4 = 3 THEN 'code' ELSE 'paragraph' END, s[sub], '' FROM ln
),
flat AS (
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1)::INTEGER AS pos, 'block' AS kind, element_type, content, 1 AS level, 'text' AS encoding, attributes,
    (row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1)::INTEGER AS element_order
  FROM raw
)
"""

_SHAPES = ", ".join("(" + ", ".join(_sql(v) for v in (i, k, t, lv, full, f"{a}={v}" if a else "")) + ")" for i, (k, t, lv, full, a, v) in enumerate(SHAPES))

NESTED = f"""{FLAT},
shape(i, k, t, l, full_, a) AS (VALUES {_SHAPES}),
nested AS (
  SELECT conv_id, pos, k AS kind, t AS element_type, CASE WHEN full_ THEN content END AS content, l::INTEGER AS level, encoding, a AS attributes, element_order
  FROM flat JOIN shape ON flat.pos % {len(SHAPES)} = shape.i
)
"""

_ODD = ", ".join("(" + ", ".join(_sql(v) for v in (i, k, t, lv, c is True, None if c is True else c, e, f"{a}={v}" if a else "", o)) + ")" for i, (k, t, lv, c, e, a, v, o) in enumerate(IRREGULAR))

IRREGULAR_ROWS = f"""{FLAT},
odd_shape(i, k, t, l, full_, c, e, a, o) AS (VALUES {_ODD}),
odd AS (
  SELECT conv_id, pos, k AS kind, t AS element_type, CASE WHEN full_ THEN content ELSE c END AS content, (CASE WHEN conv_id % 9 = 0 THEN coalesce(l, 1) + 1 ELSE l END)::INTEGER AS level, e AS encoding, a AS attributes,
    (element_order + o)::INTEGER AS element_order
  FROM flat JOIN odd_shape s ON (flat.pos + 3 * flat.conv_id) % {len(IRREGULAR)} = s.i
)
"""

DEEP_ROWS = f"""{FLAT},
deep AS (SELECT conv_id, pos, kind, CASE WHEN pos % 9 = 4 THEN 'metadata' ELSE 'div' END AS element_type, content, (1 + pos * 7 % 20)::INTEGER AS level, encoding, '' AS attributes, element_order FROM flat)
"""

#: What is hidden from the body, and the texts of units: an element with the inlines after it.
UNITS = """
hid AS (
  SELECT n.*, n.kind = 'value' OR n.element_type = 'metadata' OR EXISTS (
    SELECT 1 FROM {t} r WHERE r.conv_id = n.conv_id AND (r.kind = 'value' OR r.element_type = 'metadata') AND r.pos < n.pos
      AND NOT EXISTS (SELECT 1 FROM {t} m WHERE m.conv_id = n.conv_id AND m.pos > r.pos AND m.pos <= n.pos AND m.level <= r.level)) AS hidden,
    coalesce(max(CASE WHEN kind <> 'inline' THEN pos END) OVER (PARTITION BY conv_id ORDER BY pos), -1) AS owner
  FROM {t} n
),
units AS (
  SELECT h.conv_id, h.owner AS pos, max(CASE WHEN kind <> 'inline' THEN element_type END) AS element_type, max(CASE WHEN kind <> 'inline' THEN content END) AS content,
    max(CASE WHEN kind <> 'inline' THEN attributes END) AS attributes, max(CASE WHEN kind <> 'inline' THEN element_order END) AS element_order,
    coalesce(bool_or(CASE WHEN kind <> 'inline' THEN hidden END), true) AS lone,
    coalesce(string_agg(CASE WHEN kind = 'inline' AND NOT hidden THEN coalesce(content, '') END, '' ORDER BY h.pos), '') AS run
  FROM hid h GROUP BY h.conv_id, h.owner
),
said AS (SELECT *, CASE WHEN lone OR coalesce(content, '') = '' THEN run ELSE content END AS t FROM units)
"""

_COLUMNS = "conv_id, pos, kind, element_type, content, level, encoding, attributes, element_order"


def _units(table: str) -> str:
    return UNITS.replace("{t}", table)


def _text(separator: str) -> str:
    return f"WITH {NESTED}, {_units('nested')} SELECT conv_id, coalesce(string_agg(t, {separator} ORDER BY pos) FILTER (t <> ''), '') AS text FROM said GROUP BY conv_id"


def _nested(select: str) -> str:
    return f"WITH {NESTED} {select}"


def _flat(select: str) -> str:
    return f"WITH {FLAT} {select}"


_BLANK = "chr(10) || chr(10)"
_HEADS = "h AS (SELECT conv_id, pos, content AS title, right(attributes, 1)::INTEGER AS level, element_order AS ord FROM flat WHERE element_type = 'heading')"
_SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9_]+', '-', 'g'), '-')"
_SECTIONS = f"""{_HEADS},
named AS (SELECT *, {_SLUG} AS id, lead(ord) OVER (PARTITION BY conv_id ORDER BY ord) AS nxt, max(ord) OVER (PARTITION BY conv_id) AS x FROM h),
tail AS (SELECT conv_id, max(element_order) AS last_order FROM flat GROUP BY conv_id),
up AS (
  SELECT n.*, (SELECT max(p.ord) FROM h p WHERE p.conv_id = n.conv_id AND p.ord < n.ord AND p.level < n.level) AS parent_ord FROM named n
),
sec AS (
  SELECT u.conv_id, u.id AS section_id, concat_ws('/', g.id, p.id, u.id) AS section_path, u.level, u.title, p.id AS parent_id, u.ord AS start_order,
    coalesce(u.nxt - 1, tail.last_order)::INTEGER AS end_order, CASE WHEN u.ord < tail.last_order THEN u.ord + 1 ELSE coalesce(u.nxt - 1, tail.last_order) + 1 END::INTEGER AS content_start_order
  FROM up u JOIN tail USING (conv_id) LEFT JOIN up p ON p.conv_id = u.conv_id AND p.ord = u.parent_ord LEFT JOIN up g ON g.conv_id = p.conv_id AND g.ord = p.parent_ord
)"""
_SECTION_SPANS = f"""{_HEADS},
spans AS (
  SELECT h.conv_id, h.ord AS s, coalesce((SELECT min(x.ord) FROM h x WHERE x.conv_id = h.conv_id AND x.ord > h.ord AND x.level <= h.level) - 1, 2147483647) AS e FROM h WHERE title ILIKE '%user 0%'
),
inside AS (SELECT DISTINCT f.* FROM flat f JOIN spans USING (conv_id) WHERE f.element_order BETWEEN s AND e)"""
_SEARCH = f"""{_HEADS},
spans AS (
  SELECT conv_id, title AS section, ord AS s, coalesce(lead(ord) OVER (PARTITION BY conv_id ORDER BY ord) - 1, 2147483647) AS e FROM h
  UNION ALL
  SELECT conv_id, '(preamble)', 0, coalesce(min(ord) - 1, 2147483647) FROM flat LEFT JOIN h USING (conv_id) GROUP BY conv_id HAVING coalesce(min(ord) - 1, 2147483647) >= 0
),
texts AS (
  SELECT conv_id, section, s AS start_order, coalesce(string_agg(content, {_BLANK} ORDER BY element_order) FILTER (content <> ''), '') AS content,
    coalesce(string_agg(content, ' ' ORDER BY element_order) FILTER (content <> ''), '') AS m
  FROM spans LEFT JOIN flat USING (conv_id) WHERE element_order BETWEEN s AND e GROUP BY ALL
)"""
_PAGES = """
brk AS (SELECT conv_id, element_order AS s, row_number() OVER (PARTITION BY conv_id ORDER BY element_order)::INTEGER AS page_number FROM nested WHERE element_type = 'page_break'),
pages AS (
  SELECT conv_id, page_number, s AS start_order, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY s) - 1, 2147483647)::INTEGER AS end_order FROM brk
  UNION ALL
  SELECT conv_id, NULL, 0, min(s) - 1 FROM brk GROUP BY conv_id HAVING min(s) > 0
)"""
_PAGE_ROWS = f"{NESTED}, {_PAGES}, got AS (SELECT n.* FROM nested n JOIN (SELECT conv_id, min(start_order) AS s, max(end_order) AS e FROM pages WHERE page_number BETWEEN 1 AND 2 GROUP BY conv_id) USING (conv_id) WHERE element_order BETWEEN s AND e)"
_JSON_LINE = """'{"t":"' || CASE element_type WHEN 'heading' THEN 'H' WHEN 'code' THEN 'C' ELSE 'P' END || '","c":' || to_json(content)::VARCHAR || ',"l":' || level
|| CASE WHEN attributes <> '' THEN ',"a":{"h":"' || right(attributes, 1) || '"}' ELSE '' END || '}'"""
_SAME = f"SELECT {_COLUMNS} FROM nested"
_IN = "('heading', 'text', 'link')"


_ESC = "chr(27) || '['"
_RANK = "CASE right(attributes, 1) WHEN '1' THEN '1;38;5;219' WHEN '2' THEN '1;38;5;141' ELSE '1;38;5;75' END"
_GUTTER = f"{_ESC} || '2m┃ ' || {_ESC} || '0m'"
_CODE = f"{_GUTTER} || {_ESC} || '38;5;222m' || {_ESC} || '0m' || chr(10) || {_GUTTER} || {_ESC} || '38;5;252m' || content || {_ESC} || '0m'"
_WRAPPED = "trim(regexp_replace(content, '[ \\t]+', ' ', 'g'))"


def _renumbered(where: str, order: str = "pos") -> str:
    """Kept rows, places and orders counted anew."""
    n = f"(row_number() OVER (PARTITION BY conv_id ORDER BY {order}) - 1)::INTEGER"
    return _nested(f"SELECT conv_id, {n} AS pos, kind, element_type, content, level, encoding, attributes, {n} AS element_order FROM nested WHERE {where}")


def _placed(where: str) -> str:
    """Kept rows, places counted anew and orders as they were."""
    return _nested(f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INTEGER AS pos, kind, element_type, content, level, encoding, attributes, element_order FROM nested WHERE {where}")


_TITLES = f"{NESTED}, {_units('nested')}, hs AS (SELECT conv_id, pos, right(attributes, 1)::INTEGER AS level, t AS title, element_order FROM said WHERE element_type = 'heading')"

ORACLE_SQL = {
    "toc_conversations": _flat(f", {_HEADS} SELECT conv_id, level, title, '' AS id, (level - min(level) OVER (PARTITION BY conv_id))::INTEGER AS indent, ord AS element_order FROM h"),
    "headings": f"WITH {_TITLES} SELECT conv_id, level, title, '' AS id, element_order FROM hs",
    "outline_numbers": f"""WITH RECURSIVE {FLAT}, {_HEADS},
      hn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS n, min(level) OVER (PARTITION BY conv_id) AS least FROM h),
      o AS (
        SELECT conv_id, n, [{{'l': level, 'c': 1}}] AS st FROM hn WHERE n = 1
        UNION ALL
        SELECT hn.conv_id, hn.n, CASE WHEN k[len(k)].l = hn.level THEN k[1:len(k) - 1] || [{{'l': hn.level, 'c': k[len(k)].c + 1}}] ELSE k || [{{'l': hn.level, 'c': coalesce(st[len(k) + 1].c, 0) + 1}}] END
        FROM hn JOIN o ON o.conv_id = hn.conv_id AND hn.n = o.n + 1, LATERAL (SELECT list_filter(o.st, lambda x: x.l <= hn.level) AS k)
      )
      SELECT conv_id, ord AS element_order, level, array_to_string(list_transform(st, lambda x: x.c::VARCHAR), '.') AS outline, (level - least)::INTEGER AS indent FROM hn JOIN o USING (conv_id, n)""",
    "sections": _flat(f", {_SECTIONS} SELECT * FROM sec"),
    "sections_content": _flat(f""", {_SECTIONS}
      SELECT sec.*, coalesce((SELECT string_agg(f.content, {_BLANK} ORDER BY f.element_order) FROM flat f WHERE f.conv_id = sec.conv_id AND f.content <> '' AND f.element_order BETWEEN content_start_order AND end_order), '') AS content FROM sec"""),
    "body": f"WITH {NESTED}, {_units('nested')} SELECT {_COLUMNS} FROM hid WHERE NOT hidden",
    "to_text": _text(_BLANK),
    "match_text": _text("' '"),
    "filter_types": _placed(f"element_type IN {_IN}"),
    "exclude_types": _placed(f"element_type NOT IN {_IN}"),
    "slice_orders": _placed("element_order BETWEEN 3 AND 17"),
    "assemble": _renumbered("true", "pos DESC"),
    "reorder": _renumbered("true"),
    "concat": _placed("element_order BETWEEN 0 AND 2 OR element_order BETWEEN 5 AND 6"),
    "merge": _nested(f"""SELECT {_COLUMNS} FROM nested UNION ALL
      SELECT conv_id, pos + n, kind, element_type, content, level, encoding, attributes, element_order + n FROM nested JOIN (SELECT conv_id, count(*)::INTEGER AS n FROM nested GROUP BY conv_id) USING (conv_id)"""),
    "rebase_levels": _nested("""SELECT conv_id, pos, kind, element_type, content, level, encoding,
      CASE WHEN element_type = 'heading' THEN 'heading_level=' || least(6, right(attributes, 1)::INTEGER + 2) ELSE attributes END AS attributes, element_order FROM nested"""),
    "version_stamp": _nested("SELECT conv_id, '1.4' AS version, (count(*) + 1)::INTEGER AS n, count(*)::INTEGER AS last_order FROM nested GROUP BY conv_id"),
    "accessors": _nested("""SELECT conv_id, pos, element_type AS type, content, level, encoding, element_order AS ord, CASE WHEN element_type = 'link' THEN 'https://example.com/' END AS href,
      element_type IN ('heading', 'paragraph', 'code', 'blockquote', 'list', 'table', 'hr', 'metadata', 'image', 'raw') AS valid, 9 AS set_level, 'x' AS set_content, 3 AS set_order FROM nested"""),
    "builders": """SELECT conv_id, turn, i AS pos, kind, element_type,
        CASE i WHEN 0 THEN role WHEN 2 THEN text WHEN 4 THEN role WHEN 6 THEN role WHEN 3 THEN '' WHEN 7 THEN '' WHEN 8 THEN '' END AS content, level, 'text' AS encoding,
        CASE WHEN i = 0 THEN 'heading_level=' || (1 + turn % 3) ELSE a END AS attributes, i AS element_order
      FROM conversations, (VALUES (0, 'block', 'heading', 1, ''), (1, 'block', 'paragraph', 1, ''), (2, 'inline', 'text', 2, ''), (3, 'inline', 'space', 2, ''), (4, 'inline', 'bold', 2, ''),
        (5, 'block', 'list', 1, 'list_type=bullet;ordered=false'), (6, 'block', 'list_item', 2, 'ordered=false'), (7, 'block', 'list_item', 2, 'ordered=false'), (8, 'block', 'hr', 1, '')) s(i, kind, element_type, level, a)""",
    "code_structs": _nested("SELECT conv_id, 'sql' AS language, coalesce(content, '') AS content, element_order FROM nested WHERE element_type = 'code'"),
    "code_blocks": _placed("kind = 'block' AND element_type = 'code'"),
    "link_structs": _nested("SELECT conv_id, 'https://example.com/' AS href, coalesce(content, '') AS text, '' AS title, element_order FROM nested WHERE element_type = 'link'"),
    "links": _placed("element_type = 'link'"),
    "stats": _nested("""SELECT conv_id, element_type, count(*) AS count, sum(strlen(coalesce(content, '')))::BIGINT AS total_content_length, round(avg(strlen(coalesce(content, ''))), 6) AS avg_content_length
      FROM nested GROUP BY conv_id, element_type"""),
    "structure": _nested("""SELECT conv_id, count_if(kind = 'block')::BIGINT AS block_count, count_if(kind = 'inline')::BIGINT AS inline_count, count_if(element_type = 'heading')::BIGINT AS heading_count,
      count_if(element_type IN ('paragraph', 'plain'))::BIGINT AS paragraph_count, count_if(element_type = 'code')::BIGINT AS code_count, count_if(element_type = 'list')::BIGINT AS list_count,
      count_if(element_type = 'link')::BIGINT AS link_count, count_if(element_type = 'image')::BIGINT AS image_count,
      coalesce(min(CASE WHEN element_type = 'heading' THEN right(attributes, 1)::INTEGER END), 0) AS min_heading_level, coalesce(max(CASE WHEN element_type = 'heading' THEN right(attributes, 1)::INTEGER END), 0) AS max_heading_level,
      sum(strlen(coalesce(content, '')))::BIGINT AS total_content_length FROM nested GROUP BY conv_id"""),
    "get_section": _flat(f", {_SECTION_SPANS} SELECT {_COLUMNS} FROM inside"),
    "get_section_text": _flat(f", {_SECTION_SPANS} SELECT conv_id, coalesce(string_agg(content, {_BLANK} ORDER BY element_order) FILTER (content <> ''), '') AS text FROM inside GROUP BY conv_id"),
    "sections_like": _flat(f", {_SEARCH} SELECT conv_id, section, start_order, content FROM texts WHERE m ILIKE '%the_%'"),
    "page_rows": f"WITH {NESTED}, {_PAGES} SELECT conv_id, page_number, start_order, end_order, count(n.pos) AS block_count FROM pages LEFT JOIN nested n USING (conv_id) WHERE n.element_order BETWEEN start_order AND end_order GROUP BY ALL",
    "get_pages": f"WITH {_PAGE_ROWS} SELECT {_COLUMNS} FROM got",
    "get_pages_text": f"WITH {_PAGE_ROWS}, {_units('got')} SELECT conv_id, coalesce(string_agg(t, {_BLANK} ORDER BY pos) FILTER (t <> ''), '') AS text FROM said GROUP BY conv_id",
    "diff": f"""WITH {NESTED},
      a AS (SELECT conv_id, element_type, coalesce(content, '') AS content, min(level) AS l, count(*) AS n FROM flat GROUP BY ALL),
      b AS (SELECT conv_id, element_type, coalesce(content, '') AS content, min(level) AS l, count(*) AS n FROM nested GROUP BY ALL),
      j AS (SELECT conv_id, element_type, content, a.l AS before_level, b.l AS after_level, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (conv_id, element_type, content))
      SELECT conv_id, CASE WHEN y > x THEN 'ADDED' WHEN x > y THEN 'REMOVED' ELSE 'MOVED' END AS change, element_type, content, CASE WHEN x = y THEN x ELSE abs(x - y) END AS n, before_level, after_level
      FROM j WHERE x <> y OR before_level IS DISTINCT FROM after_level""",
    "validate": f"WITH {NESTED}, {oracle_rules.validate('nested')}",
    "validate_irregular": f"WITH {IRREGULAR_ROWS}, {oracle_rules.validate('odd')}",
    "validate_deep": f"WITH {DEEP_ROWS}, {oracle_rules.validate('deep')}",
    "lint": f"WITH {NESTED}, {oracle_rules.lint('nested')}",
    "lint_irregular": f"WITH {IRREGULAR_ROWS}, {oracle_rules.lint('odd')}",
    "quality": f"WITH {FLAT}, {oracle_rules.quality('flat')}",
    "quality_irregular": f"WITH {IRREGULAR_ROWS}, {oracle_rules.quality('odd')}",
    "body_deep": f"WITH {DEEP_ROWS}, {_units('deep')} SELECT {_COLUMNS} FROM hid WHERE NOT hidden",
    "body_pieces": f"WITH {DEEP_ROWS}, {_units('deep')} SELECT {_COLUMNS} FROM hid WHERE NOT hidden",
    "to_text_deep": f"WITH {DEEP_ROWS}, {_units('deep')} SELECT conv_id, coalesce(string_agg(t, {_BLANK} ORDER BY pos) FILTER (t <> ''), '') AS text FROM said GROUP BY conv_id",
    "headings_deep": f"WITH {DEEP_ROWS} SELECT conv_id, 1 + pos % 3 AS level, content AS title, '' AS id, element_order FROM deep WHERE pos % 4 = 1",
    "compact_lines": _flat(f"SELECT conv_id, pos, {_JSON_LINE} AS line FROM flat"),
    "compact_roundtrip": _nested(_SAME),
    "heading_blocks": f"""WITH {_TITLES} SELECT conv_id, 'block' AS kind, 'heading' AS element_type, title AS content, 1 AS level, 'text' AS encoding,
      'heading_level=' || level || ';indent=' || (level - min(level) OVER (PARTITION BY conv_id)) || ';outline=' || sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY element_order) || CASE WHEN level = 2 THEN '.1' ELSE '' END AS attributes,
      element_order FROM hs""",
    # the only lone plain is that of a list item
    "normalize": _nested("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INTEGER AS pos, kind, element_type, content, level, encoding, attributes, (element_order - gone)::INTEGER AS element_order FROM (
      SELECT conv_id, pos, kind, element_type, level, encoding, attributes, element_order, CASE WHEN element_type = 'list_item' THEN lead(content) OVER d ELSE content END AS content, coalesce(sum(CASE WHEN element_type = 'plain' THEN 1 ELSE 0 END) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
      FROM nested WINDOW d AS (PARTITION BY conv_id ORDER BY pos)) WHERE element_type <> 'plain'"""),
    # captions stand outside of figures, and the last shape jumps two levels
    "repair": _nested("""SELECT conv_id, (row_number() OVER d - 1)::INTEGER AS pos, kind, element_type, content, level, encoding, attributes, (row_number() OVER d - 1)::INTEGER AS element_order FROM (
      SELECT conv_id, pos::DOUBLE AS place, kind, element_type, content, CASE WHEN pos % 16 = 15 THEN 2 ELSE level END AS level, encoding, attributes FROM nested
      UNION ALL SELECT conv_id, pos - 0.5, 'block', 'figure', '', level - 1, 'text', '' FROM nested WHERE element_type = 'caption') WINDOW d AS (PARTITION BY conv_id ORDER BY place)"""),
    "inline_builders": """SELECT conv_id, turn, i AS pos, kind, element_type, CASE c WHEN 'r' THEN role WHEN '' THEN '' END AS content, level, 'text' AS encoding, replace(a, '%', role) AS attributes, i AS element_order
      FROM conversations, (VALUES (0, 'block', 'paragraph', 'n', 1, ''), (1, 'inline', 'link', 'r', 2, 'href=u;title=t'), (2, 'inline', 'image', 'r', 2, 'alt=%;src=s'), (3, 'inline', 'math', 'r', 2, 'display=block'),
        (4, 'inline', 'quoted', 'r', 2, 'quote_type=double'), (5, 'inline', 'cite', 'r', 2, 'key=%'), (6, 'inline', 'span', 'r', 2, 'class=c;id=i'), (7, 'inline', 'code', 'r', 2, ''),
        (8, 'inline', 'note', 'n', 2, ''), (9, 'inline', 'italic', 'r', 3, ''), (10, 'inline', 'softbreak', '', 3, ''), (11, 'inline', 'raw', 'r', 2, 'format=tex'), (12, 'inline', 'linebreak', '', 2, ''),
        (13, 'inline', 'underline', '', 2, ''), (14, 'inline', 'smallcaps', 'r', 3, '')) s(i, kind, element_type, c, level, a)""",
    "render_elements": _flat(f"SELECT conv_id, pos, CASE element_type WHEN 'heading' THEN chr(10) || {_ESC} || {_RANK} || 'm▍ ' || content || {_ESC} || '0m' WHEN 'code' THEN {_CODE} ELSE content END AS rendered FROM flat"),
    "render_documents": _flat(f"""SELECT conv_id, string_agg(CASE element_type WHEN 'heading' THEN {_ESC} || {_RANK} || 'm▍ ' || {_ESC} || {_RANK} || 'm' || {_WRAPPED} || {_ESC} || '0m' WHEN 'code' THEN {_CODE} ELSE {_WRAPPED} END,
      chr(10) || chr(10) ORDER BY pos) AS rendered FROM flat GROUP BY conv_id"""),
}
