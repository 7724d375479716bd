"""The registered queries over the driver's tables, for the library's own operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import ansi
from folia.functions import builders as B
from folia.functions import elements as E
from folia.functions import lists as L
from folia.operators import check, outline, repair, retrieve, text, tree
from folia.schema import DDL, FIELDS, to_list, to_rows
from folia.sources import compact
from folia.sources.conversations import conversation_rows, deep_rows, irregular_rows, nested_rows

DOC = ["conv_id"]


def flat_attributes(attributes: Column = None) -> Column:
    """A map as ``key=value`` pairs, sorted and joined by ``;``: maps can't be compared."""
    pairs = F.map_entries(F.col("attributes") if attributes is None else attributes)
    return F.coalesce(F.array_join(F.array_sort(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"), F.lit(""))


def flat(rows: DataFrame, doc_cols: list[str] | None = None) -> DataFrame:
    """Row form with attributes as text."""
    return rows.select(*(doc_cols or DOC), "pos", *[f for f in FIELDS if f != "attributes"], flat_attributes().alias("attributes"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_list(nested_rows(spark, sf_dir), DOC)


def on_lists(change):
    """A query that applies a Column function to each document's list."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(to_rows(lists(spark, sf_dir).select(*DOC, change(F.col("blocks")).alias("blocks")), DOC))

    return run


def on_rows(make, nested: bool = True, **more):
    """A query that applies an operator to the row form."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = nested_rows(spark, sf_dir) if nested else conversation_rows(spark, sf_dir)
        return make(rows, DOC, **more)

    return run


def toc_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.toc(conversation_rows(spark, sf_dir), DOC)


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.headings(nested_rows(spark, sf_dir), DOC).select(*DOC, "level", "title", "id", "element_order")


def outline_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.outlined(conversation_rows(spark, sf_dir), DOC).select(*DOC, "element_order", "level", "outline", "indent")


def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(outline.heading_blocks(nested_rows(spark, sf_dir), DOC, True)).drop("pos")


def code_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select(*DOC, F.explode(L.code_structs(F.col("blocks"))).alias("x")).select(*DOC, "x.*")


def link_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select(*DOC, F.explode(L.link_structs(F.col("blocks"))).alias("x")).select(*DOC, "x.*")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check.stats(nested_rows(spark, sf_dir), DOC)
    return found.withColumn("avg_content_length", F.round("avg_content_length", 6))


def version_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = lists(spark, sf_dir).select(*DOC, L.stamp(F.col("blocks")).alias("b"))
    return stamped.select(*DOC, L.version(F.col("b")).alias("version"), F.size("b").alias("n"), F.get("b", F.size("b") - 1)["element_order"].alias("last_order"))


def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.struct(*FIELDS)
    return nested_rows(spark, sf_dir).select(
        *DOC, "pos", E.type_of(b).alias("type"), E.content_of(b).alias("content"), E.level_of(b).alias("level"), E.encoding_of(b).alias("encoding"), E.order_of(b).alias("ord"),
        E.attribute(b, "href").alias("href"), E.is_valid(b).alias("valid"), E.set_level(b, 9)["level"].alias("set_level"), E.set_content(b, "x")["content"].alias("set_content"), E.set_order(b, 3)["element_order"].alias("set_order"),
    )


def builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document built from each turn: heading, paragraph with inlines, list and rule, assembled."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = L.assemble(
        F.concat(
            B.heading(1 + F.col("turn") % 3, F.col("role")),
            B.paragraph(parts=[B.text(F.col("text")), B.space(), B.bold(F.col("role"))]),
            B.list_of(F.array(F.col("role"), F.lit(None).cast("string"))),
            B.hr(),
        )
    )
    rows = to_rows(turns.select("conv_id", "turn", made.alias("blocks")), ["conv_id", "turn"])
    return flat(rows, ["conv_id", "turn"])


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the flat to the nested reading of each conversation."""
    return retrieve.diff(conversation_rows(spark, sf_dir), nested_rows(spark, sf_dir), DOC)


def compact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_form = lists(spark, sf_dir).select(*DOC, compact.to_compact(F.col("blocks")).alias("t"))
    return flat(to_rows(text_form.select(*DOC, compact.from_compact(F.col("t")).alias("blocks")), DOC))


def compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_rows(spark, sf_dir)
    return rows.select(*DOC, "pos", compact.line(F.struct(*FIELDS)).alias("line"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with itself appended."""
    return flat(to_rows(lists(spark, sf_dir).select(*DOC, L.merge(F.col("blocks"), F.col("blocks")).alias("blocks")), DOC))


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(tree.body(nested_rows(spark, sf_dir), DOC))


def get_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(retrieve.get_section(conversation_rows(spark, sf_dir), DOC, "user 0"))


def sections_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.sections_like(conversation_rows(spark, sf_dir), DOC, "the_")


def get_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(retrieve.get_pages(nested_rows(spark, sf_dir), DOC, 1, 2))


def on_source(make, source, *columns):
    """A query that applies an operator to a source's row form and keeps some columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = make(source(spark, sf_dir), DOC)
        return found.select(*DOC, *columns) if columns else found

    return run


def headings_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth of the deep rows is a heading."""
    heading = F.col("pos") % 4 == 1
    rank = F.create_map(F.lit("heading_level"), (1 + F.col("pos") % 3).cast("string"))
    rows = deep_rows(spark, sf_dir).withColumns({"element_type": F.when(heading, "heading").otherwise(F.col("element_type")), "attributes": F.when(heading, rank).otherwise(F.col("attributes"))})
    return text.headings(rows, DOC).select(*DOC, "level", "title", "id", "element_order")


def inline_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph of every kind of inline for each turn, assembled."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role = F.col("role")
    parts = [
        B.link("u", role, "t"), B.inline_image("s", role), B.math(role, True), B.quoted(role), B.cite(role), B.span(role, "i", "c"), B.inline_code(role), B.note(parts=[B.italic(role), B.softbreak()]),
        B.raw_inline(role, "tex"), B.linebreak(), B.underline(children=B.smallcaps(role)),
    ]
    rows = to_rows(turns.select("conv_id", "turn", L.assemble(B.paragraph(parts=parts)).alias("blocks")), ["conv_id", "turn"])
    return flat(rows, ["conv_id", "turn"])


def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations drawn in the dark theme, wide enough for any line."""
    docs = to_list(conversation_rows(spark, sf_dir), DOC)
    return docs.select(*DOC, ansi.render(F.col("blocks"), 1_000_000, "dark").alias("rendered"))


def render_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element drawn by itself, as an expression."""
    return conversation_rows(spark, sf_dir).select(*DOC, "pos", ansi.render_one(F.col("element_type"), F.col("content"), F.col("attributes")).alias("rendered"))


QUERIES = {
    "inline_builders": inline_builders,
    "render_documents": render_documents,
    "render_elements": render_elements,
    "toc_conversations": toc_conversations,
    "headings": headings,
    "outline_numbers": outline_numbers,
    "heading_blocks": heading_blocks,
    "sections": on_rows(outline.sections, nested=False),
    "sections_content": on_rows(retrieve.sections_with_content, nested=False),
    "body": body,
    "to_text": on_rows(text.to_text),
    "match_text": on_rows(text.to_match_text),
    "filter_types": on_lists(lambda b: L.keep_types(b, ["heading", "text", "link"])),
    "exclude_types": on_lists(lambda b: L.drop_types(b, ["heading", "text", "link"])),
    "slice_orders": on_lists(lambda b: L.slice_orders(b, 3, 17)),
    "assemble": on_lists(lambda b: L.assemble(F.concat(F.reverse(b), F.array(F.lit(None).cast(DDL))))),
    "reorder": on_lists(lambda b: L.reorder(F.reverse(b))),
    "concat": on_lists(lambda b: L.concat(L.slice_orders(b, 0, 2), L.slice_orders(b, 5, 6))),
    "merge": merged,
    "rebase_levels": on_lists(lambda b: L.rebase_levels(b, 2)),
    "version_stamp": version_stamp,
    "accessors": accessors,
    "builders": builders,
    "code_structs": code_structs,
    "code_blocks": on_lists(L.code_blocks),
    "link_structs": link_structs,
    "links": on_lists(L.links),
    "stats": stats,
    "structure": on_rows(check.structure),
    "get_section": get_section,
    "get_section_text": on_rows(retrieve.get_section_text, nested=False, pattern="user 0"),
    "sections_like": sections_like,
    "page_rows": on_rows(retrieve.page_rows),
    "get_pages": get_pages,
    "get_pages_text": on_rows(retrieve.get_pages_text, first=1, last=2),
    "diff": diff,
    "validate": on_source(check.validate, nested_rows, "element_order", "rule", "field"),
    "validate_irregular": on_source(check.validate, irregular_rows, "element_order", "rule", "field"),
    "validate_deep": on_source(check.validate, deep_rows, "element_order", "rule", "field"),
    "lint": on_source(check.lint, nested_rows, "element_order", "rule", "severity"),
    "lint_irregular": on_source(check.lint, irregular_rows, "element_order", "rule", "severity"),
    "quality": on_source(check.quality, conversation_rows, "element_order", "rule"),
    "quality_irregular": on_source(check.quality, irregular_rows, "element_order", "rule"),
    "body_deep": lambda spark, sf_dir: flat(tree.body(deep_rows(spark, sf_dir), DOC)),
    "body_pieces": lambda spark, sf_dir: flat(tree.body(deep_rows(spark, sf_dir), DOC, piece_rows=7)),
    "to_text_deep": on_source(text.to_text, deep_rows),
    "headings_deep": headings_deep,
    "compact_lines": compact_lines,
    "compact_roundtrip": compact_roundtrip,
    "normalize": on_lists(repair.normalize),
    "repair": on_lists(repair.repair),
}
