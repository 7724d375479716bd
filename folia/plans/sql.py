"""SQL names for the functions over elements and lists of elements.

``register(spark)`` creates temporary functions, so that documents can be built
and taken apart in SQL. They are expressions: the engine inlines and optimizes
them like any other. What needs a document's rows side by side is a DataFrame
operator and isn't here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from folia import vocabulary as V
from folia.schema import DDL, LIST_DDL

_NO_ATTRS = "cast(map() as map<string,string>)"


def _array(names: list[str]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def _element(kind: str, etype: str, content: str, level: str = "1", encoding: str = "'text'", attrs: str = _NO_ATTRS, order: str = "0") -> str:
    fields = zip(("kind", "element_type", "content", "level", "encoding", "attributes", "element_order"), (f"'{kind}'", etype, f"cast({content} as string)", f"cast({level} as int)", encoding, attrs, f"cast({order} as int)"), strict=True)
    return f"cast(named_struct({', '.join(f"'{n}', {v}" for n, v in fields)}) as {DDL})"


def _given(**pairs: str) -> str:
    inside = ", ".join(f"'{k.rstrip('_')}', cast({v} as string)" for k, v in pairs.items())
    return f"map_filter(map({inside}), (k, v) -> v is not null)"


def _with(b: str, **changes: str) -> str:
    """An element with fields replaced."""
    names = ("kind", "element_type", "content", "level", "encoding", "attributes", "element_order")
    return "named_struct(" + ", ".join(f"'{n}', {changes.get(n, f'{b}.{n}')}" for n in names) + ")"


_LIVE = "filter({x}, b -> b is not null)"
_NUMBERED = "transform({x}, (b, i) -> " + _with("b", element_order="cast(i as int)") + ")"


def _live(x: str) -> str:
    return _LIVE.format(x=x)


def _numbered(x: str) -> str:
    return _NUMBERED.replace("{x}", x)


def _one(kind: str, name: str, attrs: str = _NO_ATTRS, content: str = "content") -> str:
    return f"array({_element(kind, f"'{name}'", content, attrs=attrs)})"


_TEXT_INLINES = ("text", "bold", "italic", "strikethrough", "superscript", "subscript", "smallcaps", "underline", "note", "code")


#: Short names for builders, as in HTML.
ALIASES = {"p": "paragraph", "bq": "blockquote", "li": "list_item", "b": "bold", "strong": "bold", "i": "italic", "em": "italic", "s": "strikethrough", "del": "strikethrough", "sup": "superscript", "sub": "subscript"}


def functions() -> dict[str, tuple[str, str, str]]:
    """Name: (parameters, return type, body)."""
    top = f"coalesce(array_max(transform({_live('first')}, b -> coalesce(b.element_order, 0))), -1)"
    found = {
        "element_kind_names": ("", "array<string>", _array(V.KINDS)),
        "element_type_names": ("", "array<string>", _array(V.ALL_TYPES)),
        "element_encoding_names": ("", "array<string>", _array(V.ENCODINGS)),
        "element_spec_version": ("", "string", f"'{V.SPEC_VERSION}'"),
        "element_is_body": ("kind string, element_type string", "boolean", "kind in ('block', 'inline') and element_type <> 'metadata'"),
        "element_implicit_parent": ("element_type string, kind string", "string", "case when kind = 'inline' then 'plain' when kind = 'block' and element_type = 'list_item' then 'list' when kind = 'block' and element_type = 'caption' then 'figure' end"),
        "element": ("element_type string, content string", DDL, _element("block", "element_type", "content")),
        "element_from_text": ("content string", DDL, f"case when content is not null then {_element('inline', "'text'", 'content')} end"),
        "element_attr": (f"b {DDL}, key string", "string", "nullif(try_element_at(b.attributes, key), '')"),
        "element_set_order": (f"b {DDL}, v int", DDL, _with("b", element_order="v")),
        "element_set_content": (f"b {DDL}, v string", DDL, _with("b", content="v")),
        "element_set_level": (f"b {DDL}, v int", DDL, _with("b", level="v")),
        "elements_assemble": (f"blocks {LIST_DDL}", LIST_DDL, _numbered(_live("blocks"))),
        "elements_document": (f"blocks array<{LIST_DDL}>", LIST_DDL, _numbered(_live("flatten(filter(blocks, x -> x is not null))"))),
        "elements_concat": (f"first {LIST_DDL}, second {LIST_DDL}", LIST_DDL, _live(f"concat(coalesce(first, cast(array() as {LIST_DDL})), coalesce(second, cast(array() as {LIST_DDL})))")),
        "elements_merge": (f"first {LIST_DDL}, second {LIST_DDL}", LIST_DDL, f"case when first is not null or second is not null then concat(coalesce({_live('first')}, cast(array() as {LIST_DDL})), coalesce(transform({_live('second')}, b -> {_with('b', element_order=f'coalesce(b.element_order, 0) + {top} + 1')}), cast(array() as {LIST_DDL}))) end"),
        "elements_filter": (f"blocks {LIST_DDL}, types array<string>", LIST_DDL, "case when types is not null then filter(blocks, b -> b is not null and array_contains(types, coalesce(b.element_type, ''))) end"),
        "elements_exclude": (f"blocks {LIST_DDL}, types array<string>", LIST_DDL, "case when types is not null then filter(blocks, b -> b is not null and not array_contains(types, coalesce(b.element_type, ''))) end"),
        "elements_slice": (f"blocks {LIST_DDL}, start_order int, end_order int", LIST_DDL, "case when start_order is not null and end_order is not null then filter(blocks, b -> b is not null and coalesce(b.element_order, 0) between start_order and end_order) end"),
        "elements_version": (f"blocks {LIST_DDL}", "string", "get(filter(blocks, b -> b.kind = 'value' and b.element_type = 'version'), 0).content"),
        "elements_code_blocks": (f"blocks {LIST_DDL}", LIST_DDL, "filter(blocks, b -> b.kind = 'block' and b.element_type = 'code')"),
        "elements_links": (f"blocks {LIST_DDL}", LIST_DDL, "filter(blocks, b -> b.element_type = 'link' or (b.element_type = 'image' and coalesce(try_element_at(b.attributes, 'src'), '') <> ''))"),
        "build_heading": ("rank int, content string", LIST_DDL, _one("block", "heading", _given(heading_level="rank"))),
        "build_paragraph": ("content string", LIST_DDL, _one("block", "paragraph")),
        "build_plain": ("content string", LIST_DDL, _one("block", "plain")),
        "build_pre": ("language string, content string", LIST_DDL, _one("block", "code", _given(language="language"))),
        "build_blockquote": ("content string", LIST_DDL, _one("block", "blockquote")),
        "build_list_item": ("content string", LIST_DDL, _one("block", "list_item", "map('ordered', 'false')")),
        "build_hr": ("", LIST_DDL, _one("block", "hr", content="''")),
        "build_image": ("src string, alt string", LIST_DDL, _one("block", "image", _given(src="coalesce(src, '')", alt="alt"), "coalesce(alt, '')")),
        "build_link": ("href string, content string", LIST_DDL, _one("inline", "link", _given(href="href"), "coalesce(content, '')")),
        "build_space": ("", LIST_DDL, _one("inline", "space", content="''")),
        "build_softbreak": ("", LIST_DDL, _one("inline", "softbreak", content="''")),
        "build_linebreak": ("", LIST_DDL, _one("inline", "linebreak", content="''")),
        "build_raw": ("format string, content string", LIST_DDL, _one("block", "raw", "map('format', coalesce(format, 'html'))")),
    }
    item = "transform(coalesce(items, cast(array() as array<string>)), (t, i) -> " + _element("block", "'list_item'", "coalesce(t, '')", "2", attrs="map('ordered', '{o}')", order="i + 1") + ")"
    shown = lambda x: f"array_min(transform({x}, b -> coalesce(b.level, 1)))"
    under = lambda x: "transform(" + _live(f"coalesce({x}, cast(array() as {LIST_DDL}))") + ", (b, i) -> " + _with("b", level=f"cast(coalesce(b.level, 1) + 2 - {shown(_live(x))} as int)", element_order="cast(i as int)") + ")"
    # a struct with a map isn't comparable, so the sort compares by order and place alone
    by_order = "transform(array_sort(transform(" + _live("blocks") + ", (b, i) -> struct(coalesce(b.element_order, 0) as o, i as i, b as b)), (x, y) -> case when x.o < y.o then -1 when x.o > y.o then 1 else x.i - y.i end), x -> x.b)"
    rank = "coalesce(try_cast(nullif(regexp_extract(coalesce(try_element_at(b.attributes, 'heading_level'), ''), '^[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]*([+-]?[0-9]+)', 1), '') as int), b.level, 1)"
    moved = _with("b", attributes=f"map_concat(map_filter(coalesce(b.attributes, {_NO_ATTRS}), (k, v) -> k <> 'heading_level'), map('heading_level', cast(greatest(1, least(6, {rank} + coalesce(offset_, 0))) as string)))")
    top_own = f"coalesce(array_max(transform({_live('blocks')}, b -> coalesce(b.element_order, 0))), -1)"
    found |= {
        "build_ul": ("items array<string>", LIST_DDL, f"concat(array({_element('block', "'list'", 'null', attrs="map('ordered', 'false', 'list_type', 'bullet')")}), {item.replace('{o}', 'false')})"),
        "build_ol": ("items array<string>", LIST_DDL, f"concat(array({_element('block', "'list'", 'null', attrs="map('ordered', 'true', 'list_type', 'ordered')")}), {item.replace('{o}', 'true')})"),
        "build_div": (f"children {LIST_DDL}, id string, class_ string", LIST_DDL, f"concat(array({_element('block', "'div'", 'null', attrs=_given(id='id', class_='class_'))}), {under('children')})"),
        "build_metadata": ("content string", LIST_DDL, f"array({_element('block', "'metadata'", 'content', encoding="'yaml'")})"),
        "build_section": (f"rank int, title string, children {LIST_DDL}", LIST_DDL, f"concat({_one('block', 'heading', "map('heading_level', cast(coalesce(rank, 2) as string))", "coalesce(title, '')")}, transform({_live(f'coalesce(children, cast(array() as {LIST_DDL}))')}, (b, i) -> {_with('b', element_order='cast(i + 1 as int)')}))"),
        "build_math": ("content string", LIST_DDL, _one("inline", "math", "map('display', 'inline')", "coalesce(content, '')")),
        "build_quoted": ("content string", LIST_DDL, _one("inline", "quoted", "map('quote_type', 'double')", "coalesce(content, '')")),
        "build_cite": ("key string", LIST_DDL, _one("inline", "cite", _given(key="key"), "coalesce(key, '')")),
        "build_span": ("content string, id string, class_ string", LIST_DDL, _one("inline", "span", _given(id="id", class_="class_"), "coalesce(content, '')")),
        "elements_reorder": (f"blocks {LIST_DDL}", LIST_DDL, _numbered(by_order)),
        "elements_stamp": (f"blocks {LIST_DDL}", LIST_DDL, f"case when blocks is not null then concat(blocks, array({_element('value', "'version'", f"'{V.SPEC_VERSION}'", order=f'{top_own} + 1')})) end"),
        "elements_rebase_levels": (f"blocks {LIST_DDL}, offset_ int", LIST_DDL, f"transform({_live('blocks')}, b -> case when b.element_type = 'heading' and {rank} > 0 then {moved} else b end)"),
    }
    for rank in range(1, 7):
        found[f"build_h{rank}"] = ("content string", LIST_DDL, _one("block", "heading", f"map('heading_level', '{rank}')"))
    for name in _TEXT_INLINES:
        found[f"build_{name}"] = ("content string", LIST_DDL, _one("inline", name, content="coalesce(content, '')"))
    return found | {f"build_{short}": found[f"build_{long}"] for short, long in ALIASES.items()}


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions in this session and returns their names."""
    for name, (parameters, kind, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(functions())
