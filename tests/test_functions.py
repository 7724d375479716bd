"""Builders, list functions, the compact format, repair and rendering on small documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folia import vocabulary as V
from folia.functions import ansi
from folia.functions import builders as B
from folia.functions import elements as E
from folia.functions import lists as L
from folia.operators import check, outline, repair, retrieve, text, tree
from folia.schema import ELEMENT, FIELDS, LIST, accept, from_text, to_list, to_rows
from folia.sources import compact
from folia.sources.profile import profile, quote


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def brief(elements):
    """(kind initial, type, content, level, order) of each element."""
    return [(e["kind"][0], e["element_type"], e["content"], e["level"], e["element_order"]) for e in elements]


def make(kind, etype, content, level, order=0, **attrs):
    return {"kind": kind, "element_type": etype, "content": content, "level": level, "encoding": "text", "attributes": attrs, "element_order": order}


def rows_of(spark, elements):
    """Row form of one document with orders by place."""
    data = [tuple([1, i, *[(e | {"element_order": i})[f] for f in FIELDS]]) for i, e in enumerate(elements)]
    return spark.createDataFrame(data, "d int, pos int, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int")


def column_of(spark, elements):
    return spark.createDataFrame([(elements,)], f"blocks {LIST.simpleString()}")


def test_heading_forms(spark):
    assert brief(value(spark, B.heading(2, "T"))) == [("b", "heading", "T", 1, 0)]
    assert value(spark, B.heading(2, "T"))[0]["attributes"] == {"heading_level": "2"}
    assert value(spark, B.heading(F.lit(None).cast("int"), "T"))[0]["attributes"] == {}
    over = value(spark, B.heading(1, children=B.text("a")))
    assert brief(over) == [("b", "heading", None, 1, 0), ("i", "text", "a", 2, 0)]


def test_children_keep_their_nesting(spark):
    deep = B.bold(parts=[B.text("x"), B.italic("y")])
    made = value(spark, B.paragraph(parts=[deep, B.text("z")]))
    assert brief(made) == [("b", "paragraph", None, 1, 0), ("i", "bold", None, 2, 0), ("i", "text", "x", 3, 1), ("i", "italic", "y", 3, 2), ("i", "text", "z", 2, 3)]
    flat = value(spark, B.plain(children=deep))
    assert [e["level"] for e in flat] == [1, 2, 2, 2]


def test_content_over_children(spark):
    assert value(spark, B.bold(children=B.text("a")))[0]["content"] == ""
    assert value(spark, B.bold(parts=[B.text("a")]))[0]["content"] is None
    assert value(spark, B.text(None))[0]["content"] == ""


def test_blockquote_levels(spark):
    assert value(spark, B.blockquote("q", 3))[0]["level"] == 3
    assert [e["level"] for e in value(spark, B.blockquote(children=B.text("q"), level=3))] == [1, 2]
    assert [e["level"] for e in value(spark, B.blockquote(parts=[B.text("q")], level=3))] == [3, 4]


def test_lists(spark):
    items = value(spark, B.list_of(F.array(F.lit("a"), F.lit(None).cast("string")), True))
    assert brief(items) == [("b", "list", None, 1, 0), ("b", "list_item", "a", 2, 1), ("b", "list_item", "", 2, 2)]
    assert items[0]["attributes"] == {"ordered": "true", "list_type": "ordered"}
    built = value(spark, B.list_of(parts=[B.list_item("a"), B.list_item("b")]))
    assert brief(built)[1:] == [("b", "list_item", "a", 2, 0), ("b", "list_item", "b", 2, 1)]
    assert built[0]["attributes"] == {"ordered": "false"}
    assert value(spark, B.list_element(F.array(F.lit('a"b'), F.lit("c\n"))))["content"] == '["a\\"b","c\\n"]'


def test_other_builders(spark):
    assert value(spark, B.image(None, "alt"))[0]["attributes"] == {"src": "", "alt": "alt"}
    assert value(spark, B.inline_image(None))[0]["attributes"] == {}
    assert value(spark, B.math("x", True))[0]["attributes"] == {"display": "block"}
    assert value(spark, B.math_element("x"))["encoding"] == "latex"
    assert value(spark, B.quoted(parts=[B.text("a")]))[0]["attributes"] == {}
    assert value(spark, B.quoted("a"))[0]["attributes"] == {"quote_type": "double"}
    assert value(spark, B.raw("<b>"))[0]["attributes"] == {"format": "html"}
    assert value(spark, B.link("u", "t", "title"))[0]["attributes"] == {"href": "u", "title": "title"}
    assert value(spark, B.cite_element("k", "see"))["attributes"] == {"key": "k", "prefix": "see"}
    assert brief(value(spark, B.section(None, inlines=[B.text("a")]))) == [("b", "heading", None, 1, 0), ("i", "text", "a", 2, 0)]
    assert brief(value(spark, B.section(3, "T", parts=[B.paragraph("p")])))[1] == ("b", "paragraph", "p", 1, 1)
    assert brief(value(spark, B.short.doc([B.short.h1("T"), B.short.p("x"), B.short.hr()])))[2] == ("b", "hr", "", 1, 2)
    assert value(spark, getattr(B.short, "del")("x"))[0]["element_type"] == "strikethrough"


def test_lists_of_elements(spark):
    docs = column_of(spark, [make("block", "heading", "A", 1, 5, heading_level="5"), make("block", "paragraph", "p", 1, 2), make("block", "code", "c", 1, 9)])
    get = lambda c: docs.select(c.alias("x")).first()["x"]
    b = F.col("blocks")
    assert [e["content"] for e in get(L.reorder(b))] == ["p", "A", "c"]
    assert [e["element_order"] for e in get(L.merge(b, b))] == [5, 2, 9, 15, 12, 19]
    assert get(L.rebase_levels(b, 4))[0]["attributes"]["heading_level"] == "6"
    assert [e["content"] for e in get(L.slice_orders(b, 2, 5))] == ["A", "p"]
    assert get(L.slice_orders(b, F.lit(None), 5)) is None
    assert len(get(L.keep_types(b, ["code"]))) + len(get(L.drop_types(b, ["code"]))) == 3
    assert get(L.version(L.stamp(b))) == V.SPEC_VERSION
    assert get(L.stamp(b))[-1]["element_order"] == 10
    assert get(L.merge(F.lit(None).cast(LIST), F.lit(None).cast(LIST))) is None
    assert len(get(L.assemble(F.array(b, F.lit(None).cast(LIST), b), nested=True))) == 6


def test_accept_shapes(spark):
    docs = column_of(spark, [make("block", "hr", "", 1)])
    assert docs.select(accept(F.col("blocks"), docs.schema["blocks"].dataType).alias("x")).schema["x"].dataType.elementType.names == FIELDS
    wider = docs.select(F.transform("blocks", lambda e: e.withField("filename", F.lit("f"))).alias("b"))
    assert len(wider.select(accept(F.col("b"), wider.schema["b"].dataType).alias("x")).first()["x"][0]) == 7
    with pytest.raises(TypeError):
        accept(F.col("x"), spark.range(1).schema["id"].dataType)


def test_elements(spark):
    b = from_text(F.lit("t"))
    assert value(spark, E.attribute(b, "none")) is None
    assert value(spark, from_text(F.lit(None).cast("string"))) is None
    assert value(spark, E.is_valid(E.block("heading", "x"))) is True
    assert value(spark, E.is_valid(E.block("div", "x"))) is False
    assert value(spark, E.is_valid(E.block("heading", "x", order=-1))) is False
    assert value(spark, E.is_valid(F.lit(None).cast(ELEMENT))) is False
    pair = spark.createDataFrame([(("code", "x"),)], "v struct<a:string,b:string>")
    assert pair.select(E.to_element(F.col("v"), pair.schema["v"].dataType).alias("x")).first()["x"]["content"] == "x"
    assert len(V.ALL_TYPES) == 44


def test_forms_go_and_come_back(spark):
    docs = column_of(spark, [make("block", "paragraph", "p", 1, 0), None, make("block", "hr", "", 1, 1)]).withColumn("d", F.lit(1))
    assert to_rows(docs, ["d"]).count() == 2
    assert len(to_list(to_rows(docs, ["d"]), ["d"]).first()["blocks"]) == 2


def test_text_of_values_and_tables(spark):
    table = make("block", "table", '{"headers":["a"],"rows":[["b",1,""],["c"]]}', 1) | {"encoding": "json"}
    rows = rows_of(spark, [make("inline", "text", "stray", 1), make("value", "map", "", 1), make("inline", "text", "no", 2), make("inline", "text", "yes", 1), table, make("block", "hr", "", 1), make("inline", "text", "gone", 2), make("block", "paragraph", "", 1), make("inline", "text", "a", 2), make("inline", "space", "", 2), make("inline", "image", "", 2, alt="b")])
    assert text.to_text(rows, ["d"], "|").first()["text"] == "stray|yes|a|b|c|a b"
    assert tree.body(rows, ["d"]).count() == 9


def test_sections_with_repeated_titles(spark):
    titles = ["A", "A", "A", "A", "A-1", "", "Café Über_snake 2.0: v3"]
    rows = rows_of(spark, [make("block", "heading", t, 1, heading_level="1") for t in titles])
    found = [r["section_id"] for r in outline.sections(rows, ["d"]).orderBy("start_order").collect()]
    assert found == ["a", "a-1", "a-1-1", "a-1-2", "a-1-3", "", "caf-ber_snake-2-0-v3"]


def test_outline_numbers(spark):
    rows = rows_of(spark, [make("block", "heading", "t", 1, heading_level=str(r)) for r in (1, 3, 2, 2, 3, 1)])
    assert [r["outline"] for r in outline.outlined(rows, ["d"]).orderBy("pos").collect()] == ["1", "1.1", "1.2", "1.3", "1.3.1", "2"]


def test_headings_inside_values_are_hidden(spark):
    rows = rows_of(spark, [make("value", "blocks", "", 1), make("block", "heading", "in", 2), make("value", "string", "", 2), make("block", "heading", "back", 2), make("block", "heading", "out", 1)])
    assert [r["title"] for r in text.headings(rows, ["d"]).orderBy("pos").collect()] == ["back", "out"]


def test_pages(spark):
    b = lambda n: make("block", "page_break", "", 1, page_number=n)
    rows = rows_of(spark, [make("block", "paragraph", "front", 1), b("7"), make("block", "paragraph", "p", 1), make("block", "page_break", "", 1), make("block", "paragraph", "q", 1)])
    pages = retrieve.page_rows(rows, ["d"], blocks=True).orderBy("start_order").collect()
    assert [(p["page_number"], p["start_order"], p["end_order"], p["block_count"]) for p in pages] == [(None, 0, 0, 1), (7, 1, 2, 2), (2, 3, V.MAX_INT, 2)]
    assert all(p["block_count"] == len(p["blocks"]) for p in pages)
    assert retrieve.get_pages_text(rows, ["d"], 7, 7).first()["text"] == "p"


def test_search_wildcards_and_phrases(spark):
    rows = rows_of(spark, [make("block", "paragraph", "here", 1), make("block", "paragraph", "second a_b", 1), make("block", "heading", "T", 1)])
    assert retrieve.sections_like(rows, ["d"], "HERE second").first()["section"] == "(preamble)"
    assert retrieve.sections_like(rows, ["d"], "a\\_b").count() == 0


def test_validate_and_lint(spark):
    good = rows_of(spark, [make("block", "heading", "T", 1, heading_level="1"), make("block", "paragraph", "p", 1)])
    assert check.validate(good, ["d"]).count() == 0
    assert check.validity(good, ["d"]).first()["valid"] is True
    bad = rows_of(spark, [make("inline", "text", "x", 1), make("value", "map", "", 1), make("inline", "text", "y", 1), make("block", "list_item", "z", 3), make("what", "", "", 0)])
    rules = sorted((r["element_order"], r["rule"]) for r in check.validate(bad, ["d"]).collect())
    assert rules == [(0, "L5"), (2, "L5"), (2, "L6"), (3, "L4"), (3, "V3"), (4, "V2"), (4, "V5"), (4, "V6")]
    lint = {r["rule"] for r in check.lint(rows_of(spark, [make("block", "heading", "a", 1), make("block", "list", "x", 1), make("block", "div", "", 1), make("block", "paragraph", "", 1), make("block", "deflist", "x", 1), make("block", "odd", "x", 1), make("block", "table", "x", 1)]), ["d"]).collect()}
    assert lint == {"rank_missing", "list_content", "childless_container", "empty_element", "deflist", "unknown_type", "table_schema"}


def test_normalize_to_a_fixpoint(spark):
    chain = [make("block", "paragraph", "", 1, 0), make("block", "plain", "", 2, 1), make("block", "plain", "", 3, 2), make("block", "plain", "foo", 4, 3), make("block", "hr", "", 1, 4)]
    once = repair.normalize_elements(chain)
    assert [(e["element_type"], e["content"], e["element_order"]) for e in once] == [("paragraph", "foo", 0), ("hr", "", 1)]
    assert repair.normalize_elements(once) == once
    tight = [make("block", "list_item", "", 1, 0), make("block", "plain", "a", 2, 1), make("block", "plain", "b", 2, 2)]
    assert repair.normalize_elements(tight) == tight


def test_repair_validates_clean(spark):
    broken = [make("block", "list_item", "a", 1), make("inline", "text", "b", 1), make("block", "caption", "c", 1), make("block", "paragraph", "", 3), make("block", "code", "x", 7)]
    fixed = repair.repair_elements(broken)
    assert [(e["element_type"], e["level"]) for e in fixed] == [("list", 1), ("list_item", 2), ("plain", 1), ("text", 2), ("figure", 1), ("caption", 2), ("paragraph", 3), ("code", 4)]
    assert repair.repair_elements(fixed) == fixed
    assert check.validate(rows_of(spark, fixed), ["d"]).count() == 0
    deep = [make("block", "paragraph", "a", 3), make("block", "paragraph", "b", 5)]
    assert [e["level"] for e in repair.repair_elements(deep)] == [1, 2]


def test_compact_round_trip(spark, tmp_path):
    hard = [
        make("block", "heading", "t\tn\n\"q\\ \x01 é 😀   /", 1, 0, heading_level="1", c="own"),
        make("inline", "caption:x", None, 2, 1), make("block", "paragraph", "", 1, 2), make("value", "version", "1.4", 1, 3) | {"encoding": "yaml"},
    ]
    docs = column_of(spark, hard)
    written = docs.select(compact.to_compact(F.col("blocks")).alias("t")).first()["t"]
    assert written.splitlines()[0] == '{"@":"4.2.0"}'
    assert '\\u0001' in written and " " in written and '"t":"inline:caption:x"' in written
    assert '"a":{"h":"1"},"m":{"c":"own"}' in written
    back = docs.select(compact.from_compact(compact.to_compact(F.col("blocks"))).alias("x")).first()["x"]
    assert [e.asDict() for e in back] == hard
    compact.write_compact(docs, str(tmp_path / "out"))
    assert compact.read_compact(spark, str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("line", ['{"t":"Z","l":1}', '{"t":"P","l":1,"a":{"zz":"1"}}', '{"t":"P"}'])
def test_compact_refusals(spark, tmp_path, line):
    (tmp_path / "bad.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match="compact"):
        compact.read_compact(spark, str(tmp_path / "bad.jsonl")).count()


def test_compact_numbers_lines_across_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 2000)):
        (tmp_path / f"{name}.jsonl").write_text('{"@":"4.2.0"}\n\n' + "".join(f'{{"t":"P","c":"{i}","l":1}}\n' for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = compact.read_compact(spark, str(tmp_path / "*.jsonl"))
        assert rows.count() == 5000
        assert rows.where("content <> cast(element_order as string)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_render_blocks(spark):
    r = ansi.Renderer(20, "dark")
    assert r.document([make("block", "heading", "T", 1, heading_level="1"), make("block", "hr", "", 1)]) == "\x1b[1;38;5;219m▍ \x1b[1;38;5;219mT\x1b[0m\n\n\x1b[2m" + "─" * 20 + "\x1b[0m"
    assert r.document([make("block", "paragraph", "", 1), make("inline", "text", "see ", 2), make("inline", "link", "x", 2, href="u")]) == "see \x1b[4;38;5;75mx\x1b[0m\x1b[2m (u)\x1b[0m"
    items = [make("block", "list", "", 1, ordered="true"), make("block", "list_item", "a", 2), make("block", "list_item", "b", 2)]
    assert ansi._PIECE.sub(lambda m: "" if m[0][0] == "\x1b" else m[0], r.document(items)) == " 1. a\n 2. b"
    assert r.document([make("value", "map", "", 1), make("inline", "text", "no", 2), make("inline", "text", "nor", 1)]) == ""
    table = make("block", "table", '{"headers":["a","b"],"rows":[[1,2.50],[true]]}', 1)
    plain = [ansi._PIECE.sub(lambda m: "" if m[0][0] == "\x1b" else m[0], x) for x in r.document([table]).split("\n")]
    assert plain == ["a    │ b", "─" * 4 + "─┼─" + "─" * 4, "1    │ 2.50", "true │ "]


def test_wrap_keeps_styles_and_width():
    for line in ansi.wrap("\x1b[1mone two three four\x1b[22m five 漢字漢字漢字漢字漢字", 10):
        assert ansi.display_width(line) <= 10
    assert ansi.wrap("\x1b[1mab cd\x1b[22m", 2) == ["\x1b[1mab\x1b[0m", "\x1b[1mcd\x1b[22m"]
    assert ansi.display_width("é漢\x1b[1m!") == 4


def test_wrap_lays_out_short_texts_once():
    text, longer = "styled \x1b[1mwords\x1b[0m that come again", "words " * 200
    seen = ansi._short_laid.cache_info()
    first = ansi.wrap(text, 12, ansi.Prefix("> ", "  ", 2))
    first.append("own")
    again = ansi.wrap(text, 12, ansi.Prefix("> ", "  ", 2))
    assert again == first[:-1] and again != ansi.wrap(text, 12) and ansi.wrap(longer, 12) == ansi.wrap(longer, 12)
    now = ansi._short_laid.cache_info()
    assert (now.hits - seen.hits, now.misses - seen.misses) == (1, 2)


def test_render_columns(spark):
    docs = column_of(spark, [make("block", "paragraph", "hi", 1)])
    assert docs.select(ansi.render(F.col("blocks"), 40, "light").alias("x")).first()["x"] == "hi"
    assert value(spark, ansi.render_one(F.lit("heading"), F.lit("T"), F.create_map(F.lit("heading_level"), F.lit("1")))) == "\n\x1b[1;38;5;219m▍ T\x1b[0m"
    got = value(spark, ansi.json_to_table(F.lit('[{"a":"1","b":"x"},{"a":"2"}]')))
    assert got["content"] == '{"headers":["a","b"],"rows":[["1","x"],["2",""]]}'
    assert "3" in ansi.render_query(spark.range(3, 4), 40).first()["rendered"]
    assert len(value(spark, ansi.page("R", [B.paragraph("x")]))) == 2
    assert value(spark, ansi.list_lines(F.lit('["a"]'), F.lit("true"))) == "\x1b[38;5;212m 1. \x1b[0ma"
    assert value(spark, ansi.code_lines(F.lit("x\n"), F.lit("py"))).count("\n") == 1


def test_profile(spark):
    rows = {r["column_name"]: r for r in profile(spark.range(5).withColumn("s", F.lit(None).cast("string"))).collect()}
    assert rows["id"]["max"] == "4" and rows["s"]["null_count"] == 5
    assert (rows["id"]["q25"], rows["id"]["q50"], rows["id"]["q75"], rows["s"]["null_percentage"]) == ("1", "2", "3", 100.0) and rows["id"]["std"] == pytest.approx(2.5**0.5)
    assert quote("a'b") == "'a''b'" and quote(None) == "''"


def test_properties_of_lists(spark):
    """Merging adds lengths; filter and exclude part a list; reordering keeps its length."""
    docs = column_of(spark, [make("block", t, "x", 1, i) for i, t in enumerate(["code", "hr", "list", "code"])])
    b = F.col("blocks")
    row = docs.select(F.size(L.merge(b, b)), F.size(L.keep_types(b, ["code"])), F.size(L.drop_types(b, ["code"])), F.size(L.reorder(b))).first()
    assert tuple(row) == (8, 2, 2, 4)


@pytest.mark.parametrize("levels", [13, 40, 300])
def test_documents_of_any_depth(spark, levels):
    nested = [make("block", "list" if i % 2 else "list_item", "", i + 1) for i in range(levels)]
    doc = [make("block", "heading", "Top", 1, heading_level="1"), *nested, make("inline", "text", "deep", levels + 1), make("block", "metadata", "", 1), *[make("block", "div", "gone", i + 2) for i in range(levels)]]
    rows = rows_of(spark, doc)
    assert text.to_text(rows, ["d"]).first()["text"] == "Top\n\ndeep"
    assert [r["title"] for r in text.headings(rows, ["d"]).collect()] == ["Top"] == [r["title"] for r in outline.toc(rows, ["d"]).collect()]
    assert tree.body(rows, ["d"]).count() == levels + 2
    assert {r["rule"] for r in check.validate(rows, ["d"]).collect()} == {"L4"} and "empty_element" not in {r["rule"] for r in check.lint(rows, ["d"]).collect()}


def test_quality_goes_by_the_next_larger_order(spark):
    doc = [make("block", "heading", "A", 1, heading_level="2"), make("block", "paragraph", "same order", 1), make("block", "heading", "B", 1, heading_level="2")]
    rows = rows_of(spark, doc).withColumn("element_order", F.when(F.col("pos") < 2, 0).otherwise(1))
    assert [(r["rule"], r["element_order"]) for r in check.quality(rows, ["d"]).collect()] == [("empty_section", 0)]


def test_normalize_many_tight_items():
    doc = [make("block", "list", "", 1)]
    for i in range(100_000):
        doc += [make("block", "list_item", "", 2, 2 * i + 1), make("block", "plain", "x", 3, 2 * i + 2)]
    out = repair.normalize_elements(doc)
    assert len(out) == 100_001 and all(e["content"] == "x" for e in out[1:]) and [e["element_order"] for e in out] == list(range(100_001))


def test_many_jumps_take_time_in_proportion():
    import time

    from folia.operators.repair import repair_elements

    def nested(n):
        return [{"kind": "block", "element_type": "div", "content": "", "level": 1 + 2 * i, "encoding": "text", "attributes": {}, "element_order": i} for i in range(n)]

    began = time.process_time()
    assert [e["level"] for e in repair_elements(nested(60_000))] == list(range(1, 60_001))
    assert time.process_time() - began < 10
