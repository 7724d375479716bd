"""DuckDB SQL for the queries of :mod:`folia.plans.queries_built`."""

from __future__ import annotations

from folia.functions.ansi import RULE_WIDTH
from folia.plans import oracle
from folia.plans.oracle import _BLANK, _ESC, _SEARCH, _SECTIONS, FLAT, IRREGULAR_ROWS, NESTED, _units
from folia.vocabulary import ALL_TYPES, ENCODINGS, KINDS


def _list(rows: str) -> str:
    """Elements of each turn from lines of "kind type content level encoding attributes": R is the role, T the text, - null, 0 empty; R in attributes is the role."""
    values = []
    for i, row in enumerate(rows.strip().splitlines()):
        kind, name, content, level, encoding, attributes = row.split()
        values.append(f"({i}, '{kind}', '{name}', '{content}', {level}, '{encoding}', '{'' if attributes == '-' else attributes}')")
    return f"""SELECT conv_id, turn, i AS pos, kind, element_type, CASE c WHEN 'R' THEN role WHEN 'T' THEN text WHEN '-' THEN NULL WHEN '0' THEN '' ELSE substr(c, 2) END AS content, level, encoding,
      replace(a, 'R', role) AS attributes, i AS element_order FROM conversations, (VALUES {", ".join(values)}) s(i, kind, element_type, c, level, encoding, a)"""


_BLOCKS = """
block plain T 1 text -
block code T 1 text language=R
block blockquote R 1 text -
block blockquote R 2 text -
block list_item R 1 text ordered=true
block metadata R 1 yaml -
block image =alt 1 text alt=alt;src=R
block raw R 1 text format=tex
block div - 1 text id=i
block paragraph R 2 text -
block heading =T 1 text heading_level=2
block paragraph R 1 text -
block hr 0 1 text -
block heading - 1 text heading_level=1
inline text R 2 text -
block heading R 1 text heading_level=3
"""
_CHILDREN = """
block heading - 1 text heading_level=1
inline text R 2 text -
block paragraph - 1 text -
inline text R 2 text -
inline text =x 2 text -
block plain - 1 text -
inline text R 2 text -
block blockquote - 1 text -
block paragraph R 2 text -
block list - 1 text ordered=false
block list_item R 2 text ordered=false
inline bold 0 1 text -
inline text R 2 text -
inline strikethrough R 1 text -
inline superscript R 1 text -
inline subscript R 1 text -
inline link - 1 text href=u
inline text R 2 text -
inline quoted - 1 text -
inline text R 2 text -
inline span 0 1 text -
inline text R 2 text -
block heading - 1 text -
inline text R 2 text -
inline italic - 2 text -
inline text =y 3 text -
"""
_BY_SQL = """
block heading R 1 text heading_level=2
block paragraph T 1 text -
block list - 1 text list_type=bullet;ordered=false
block list_item R 2 text ordered=false
block list_item 0 2 text ordered=false
block list - 1 text list_type=ordered;ordered=true
block list_item R 2 text ordered=true
block div - 1 text id=i
block paragraph R 2 text -
block metadata R 1 yaml -
block heading R 1 text heading_level=3
block hr 0 1 text -
inline math R 1 text display=inline
inline quoted R 1 text quote_type=double
inline cite R 1 text key=R
inline span R 1 text class=c;id=i
inline bold R 1 text -
inline link R 1 text href=u
block code T 1 text language=sql
value version =1.4 1 text -
"""

#: Irregular rows as the text of documents sees them: other kinds hide like values, an image without content shows what it has instead.
_TEXT_ROWS = f"""{IRREGULAR_ROWS},
said_rows AS (
  SELECT conv_id, pos, CASE WHEN kind = 'odd' THEN 'value' ELSE kind END AS kind, element_type, CASE WHEN kind = 'inline' AND element_type = 'image' THEN 'picture' ELSE content END AS content,
    coalesce(level, 1) AS level, encoding, attributes, element_order
  FROM odd
)"""
_CELLS = """CASE WHEN element_type = 'raw' THEN '' WHEN t = '{"rows":[["p"]]}' THEN 'p' WHEN t LIKE '{"headers":["a","b"]%' THEN array_to_string(['a', 'b', 'x', 'y', 'z'], chr(10) || chr(10)) ELSE t END"""


def _drawn(h1: str, quote: str, bullet: str) -> str:
    """A page of 40 columns: lines of three or four words of nine letters, whatever the role."""
    e = lambda code: f"{_ESC} || '{code}m'"
    w = lambda n: "'" + " ".join(["abcdefghi"] * n) + "'"
    nl, bar = "chr(10)", f"{e(quote)} || '▌ ' || {e('0')} || {e(quote)}"
    parts = [
        e(h1), "'▍ '", e(h1), "role", e("0"), nl, nl, w(4), nl, w(4), nl, nl, bar, w(3), e("0"), nl, bar, w(3), e("0"), nl, bar, w(2), "' '", e("0"), nl,
        e(bullet), "'  • '", e("0"), "role", nl, e(bullet), "'  • '", e("0"), w(3), nl, "'    '", w(3), nl, "'    '", w(2), nl, nl, e("2"), "repeat('─', 40)", e("0"), nl, nl,
        e("1"), "'a'", e("0"), e("2"), "' │ '", e("0"), e("1"), "'b'", e("0"), nl, e("2"), "'──┼───'", e("0"), nl, "'x'", e("2"), "' │ '", e("0"), "'yy'", nl, "'z'", e("2"), "' │ '", e("0"),
    ]
    return " || ".join(parts)


_BY_ALIAS = """
block paragraph T 1 text -
block blockquote R 1 text -
block list_item R 1 text ordered=false
inline bold R 1 text -
inline bold R 1 text -
inline italic R 1 text -
inline italic R 1 text -
inline strikethrough R 1 text -
inline strikethrough R 1 text -
inline superscript R 1 text -
inline subscript R 1 text -
"""

_PROFILED = "SELECT '{c}' AS column_name, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, {n}, count(*) AS count, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_percentage FROM orders"
_NUMBERS = "round(avg({c}), 3)::DOUBLE AS avg, round(stddev({c}), 3)::DOUBLE AS std"

ORACLE_SQL = {
    "block_builders": _list(_BLOCKS),
    "children_builders": _list(_CHILDREN),
    "sql_builders": _list(_BY_SQL),
    "sql_aliases": _list(_BY_ALIAS),
    "element_forms": f"""WITH {IRREGULAR_ROWS} SELECT conv_id, pos, 'block' AS kind, level, encoding, element_order AS ord, attributes, 'block' AS short_kind, element_type AS short_type, 1 AS short_level,
      CASE WHEN content IS NOT NULL THEN 'text' END AS inline_type,
      element_type IN ('heading', 'paragraph', 'code', 'blockquote', 'list', 'table', 'hr', 'metadata', 'image', 'raw') AND encoding <> 'rot13' AND coalesce(element_order, 0) >= 0 AS valid,
      CASE WHEN kind = 'inline' THEN 'plain' WHEN kind = 'block' AND element_type = 'list_item' THEN 'list' WHEN kind = 'block' AND element_type = 'caption' THEN 'figure' END AS parent,
      kind IN ('block', 'inline') AND element_type <> 'metadata' AS body, {len(KINDS)} AS kinds, {len(ALL_TYPES)} AS types, {len(ENCODINGS)} AS encodings, '1.4' AS version FROM odd""",
    "compact_files": f"WITH {NESTED} SELECT kind, element_type, content, level, encoding, attributes, true AS numbered FROM nested",
    "compact_source_rows": f"WITH {NESTED} SELECT kind, element_type, content, level, encoding, attributes, true AS numbered FROM nested",
    "compact_source_types": f"WITH {NESTED} SELECT element_type, count(*) AS n FROM nested GROUP BY element_type",
    "sections_blocks": f"""WITH {FLAT}, {_SECTIONS}
      SELECT sec.conv_id, section_id, start_order, CASE WHEN f.pos IS NOT NULL THEN (row_number() OVER (PARTITION BY sec.conv_id, start_order ORDER BY f.pos) - 1)::INTEGER END AS i, f.element_type, f.content
      FROM sec LEFT JOIN flat f ON f.conv_id = sec.conv_id AND f.element_order BETWEEN content_start_order AND end_order""",
    "sections_like_blocks": f"""WITH {FLAT}, {_SEARCH}
      SELECT t.conv_id, t.section, t.start_order, (row_number() OVER (PARTITION BY t.conv_id, t.start_order ORDER BY f.pos) - 1)::INTEGER AS i, f.element_type, f.content
      FROM texts t JOIN spans s ON s.conv_id = t.conv_id AND s.s = t.start_order AND s.section = t.section JOIN flat f ON f.conv_id = t.conv_id AND f.element_order BETWEEN s.s AND s.e WHERE t.m ILIKE '%the_%'""",
    "pages_blocks": f"""WITH {NESTED},
      brk AS (SELECT conv_id, element_order AS s, pos + 100 AS page_number FROM nested WHERE element_type = 'page_break'),
      pages AS (
        SELECT conv_id, page_number::INTEGER AS page_number, s AS start_order, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY s) - 1, 2147483647)::INTEGER AS end_order FROM brk
        UNION ALL SELECT conv_id, NULL, 0, min(s) - 1 FROM brk GROUP BY conv_id HAVING min(s) > 0
      )
      SELECT p.conv_id, page_number, start_order, end_order, count(n.pos) OVER w AS block_count, (row_number() OVER (w ORDER BY n.pos) - 1)::INTEGER AS i, element_type, content
      FROM pages p JOIN nested n ON n.conv_id = p.conv_id AND n.element_order BETWEEN start_order AND end_order WINDOW w AS (PARTITION BY p.conv_id, start_order)""",
    "sections_repeated": f"""WITH {FLAT}, h AS (SELECT conv_id, element_order, split_part(content, ' ', 1) AS title, row_number() OVER (PARTITION BY conv_id, split_part(content, ' ', 1) ORDER BY pos) AS k FROM flat WHERE element_type = 'heading')
      SELECT conv_id, title || CASE k WHEN 1 THEN '' WHEN 2 THEN '-1' ELSE '-1-' || (k - 2) END AS section_id, title, element_order AS start_order FROM h""",
    "to_text_irregular": f"WITH {_TEXT_ROWS}, {_units('said_rows')}, told AS (SELECT conv_id, pos, {_CELLS} AS t FROM said) SELECT conv_id, coalesce(string_agg(t, {_BLANK} ORDER BY pos) FILTER (t <> ''), '') AS text FROM told GROUP BY conv_id",
    "link_structs_irregular": f"""WITH {IRREGULAR_ROWS} SELECT conv_id, CASE element_type WHEN 'image' THEN 'a.png' ELSE 'https://example.com/' END AS href, coalesce(content, '') AS text, '' AS title, coalesce(element_order, 0) AS element_order
      FROM odd WHERE element_type = 'link' OR (element_type = 'image' AND attributes = 'src=a.png')""",
    "profile_orders": " UNION ALL ".join(
        _PROFILED.replace("{n}", _NUMBERS if number else "NULL::DOUBLE AS avg, NULL::DOUBLE AS std").replace("{c}", c) for c, number in (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True))
    ),
    "render_narrow": f"SELECT conv_id, turn, {_drawn('1;38;5;125', '3;38;5;28', '38;5;161')} AS light, {_drawn('1;38;5;219', '3;38;5;115', '38;5;212')} AS dark FROM conversations",
}
# table functions give what the operators give
ORACLE_SQL |= {f"sql_{name}": oracle.ORACLE_SQL[of] for name, of in (("sections", "sections"), ("section", "get_section"), ("violations", "validate_irregular"))}
ORACLE_SQL |= {
    "profile_file_orders": ORACLE_SQL["profile_orders"],
    "profile_merged": f"SELECT *, true AS near FROM ({ORACLE_SQL['profile_orders']})",
    "parquet_elements": f"WITH {NESTED} SELECT {oracle._COLUMNS}, '1.4' AS version FROM nested",
}

_STYLED = "chr(27) || '[{}m'"
_RESET = "chr(27) || '[0m'"


def _style(code: str, text: str) -> str:
    return f"{_STYLED.format(code)} || {text} || {_RESET}"


_GUTTER = _style("2", "'\u2503 '")
_LINES = f"list_transform(string_split(regexp_replace(text, '\\n+$', ''), chr(10)), lambda x: {_GUTTER} || {_style('38;5;252', 'x')})"
_MARKED = "'  \u2022 '"


def _items(first: str, second: str) -> str:
    return f"{_style('38;5;212', first)} || role || chr(10) || {_style('38;5;212', second)} || 'b'"


_BAR = _style("2", "' \u2502 '")
_WHO = "greatest(length(role), 3)"
_N = "greatest(length(turn::VARCHAR), 1)"
ORACLE_SQL |= {
    "compact_refused_elements": f"""WITH {FLAT} SELECT conv_id, pos, CASE WHEN pos % 5 = 1 THEN 'null level' WHEN pos % 7 = 1 THEN 'null encoding' WHEN pos % 6 = 1 THEN 'encoding is a reserved code'
      WHEN pos % 13 = 1 THEN 'null attributes' WHEN pos % 11 = 1 THEN 'null attribute value' END AS refusal FROM flat""",
    "compact_refused_lines": """WITH t AS (SELECT conv_id, turn, role, conv_id * 7 + turn AS n FROM conversations)
      SELECT conv_id, turn, CASE WHEN n % 5 IN (0, 2) THEN 'unknown type code' WHEN n % 3 = 0 THEN 'unknown attribute code' WHEN n % 4 = 0 THEN 'missing level' END AS refusal FROM t""",
    "render_parts": f"""SELECT conv_id, turn, {_style('1;31', 'role')} AS styled, rpad(role, greatest(9, length(role))::INTEGER, ' ') AS padded,
      {_GUTTER} || {_style('38;5;222', 'role')} || chr(10) || array_to_string({_LINES}, chr(10)) AS code, {_items("' 1. '", "' 2. '")} AS list,
      CASE WHEN turn % 2 = 0 THEN {_items("' 1. '", "' 2. '")} ELSE {_items(_MARKED, _MARKED)} END AS one_list,
      {_style('3;38;5;115', "'\u258c ' || replace(text, chr(10), chr(10) || '\u258c ')")} AS one_quote, {_style('2', f"repeat('\u2500', {RULE_WIDTH})")} AS one_rule, '' AS one_metadata,
      CASE WHEN turn > 0 THEN text ELSE '' END AS literal FROM conversations""",
    "render_tables": f"""SELECT conv_id, turn, 'table' AS element_type, 'json' AS encoding,
      '{{"headers":["who","n"],"rows":[["' || role || '","' || turn || '"],["' || role || '",""]]}}' AS content,
      {_style('1', f"rpad('who', {_WHO}::INTEGER, ' ')")} || {_BAR} || {_style('1', f"rpad('n', {_N}::INTEGER, ' ')")} || chr(10)
      || {_style('2', f"repeat('\u2500', {_WHO}) || '\u2500\u253c\u2500' || repeat('\u2500', {_N})")} || chr(10)
      || rpad(role, {_WHO}::INTEGER, ' ') || {_BAR} || rpad(turn::VARCHAR, {_N}::INTEGER, ' ') || chr(10) || rpad(role, {_WHO}::INTEGER, ' ') || {_BAR} || repeat(' ', {_N}) AS drawn FROM conversations""",
    "render_result": """SELECT '{"headers":["role","n"],"rows":[' || string_agg('["' || role || '","' || n || '"]', ',' ORDER BY role) || ']}' AS content
      FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role)""",
    "render_wide": """SELECT conv_id, turn, array_to_string(['\u6f22\u5b57\u6f22\u5b57\u6f22', '\u6f22\u5b57\u6f22\u5b57\u6f22', '\u6f22\u5b57\u6f22\u5b57\u6f22', 'e\u0301e\u0301 \U0001f468\u200d\U0001f469\u200d\U0001f467', '', role], chr(10)) AS rendered FROM conversations""",
}
