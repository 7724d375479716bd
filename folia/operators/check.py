"""Conformance, lint, quality and statistics of documents, in the row form.

Findings have a ``rule`` to tell them by and a ``message`` to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.functions.lists import rank_of
from folia.operators.tree import Related, by_document, depth
from folia.vocabulary import ALL_TYPES, CONTAINER_TYPES, CONTENTLESS_TYPES, ENCODINGS, KINDS


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _attr(key: str) -> Column:
    return F.coalesce(F.try_element_at("attributes", F.lit(key)), F.lit(""))


def _findings(marked: DataFrame, doc_cols: list[str], rules: list[tuple[str, Column, Column, Column, list[Column]]], extra: list[str]) -> DataFrame:
    """Rows for the rules that hold: each row makes an array of its findings, in one pass over the table."""
    made = [F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(rule).alias("rule"), message.alias("message"), order.alias("element_order"), *more)) for rule, holds, message, order, more in rules]
    return marked.select(*doc_cols, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f")).select(*doc_cols, *[F.col("f")[c].alias(c) for c in ("element_order", "rule", *extra, "message")])


def validate(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """Violations: (element_order, rule, field, message). A document without any is valid. Rules V1 to V9, L1, L2, L4, L5, L6."""
    run = by_document(doc_cols)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*doc_cols)
    level = F.col("level")
    kind, etype = _text("kind"), _text("element_type")
    marked = (
        rows.withColumns({
            "__prev_level": F.last("level", ignorenulls=True).over(before),
            "__nth": F.row_number().over(Window.partitionBy(*doc_cols, "element_order").orderBy("pos")),
            "__order": F.coalesce("element_order", F.lit(-1)),
            "__start": F.row_number().over(run) == 1,
            "__last_order": F.lag(F.coalesce("element_order", F.lit(-1))).over(run),
            "__min_level": F.min(depth(level)).over(whole),
            "__min_pos": F.min_by("pos", F.struct(depth(level), F.col("pos"))).over(whole),
        })
    )
    related = Related(marked, doc_cols, {"not_inline": kind != "inline", "list": (kind == "block") & etype.isin("list", "deflist"), "figure": (kind == "block") & etype.isin("figure", "table")})
    marked = related.df
    stray = F.when(kind == "inline", ~related.above("not_inline")).when((kind == "block") & (etype == "list_item"), ~related.above("list")).when((kind == "block") & (etype == "caption"), ~related.above("figure"))
    document = (kind == "block") & (etype == "document") & (level == 0)
    low = (level < 1) & ~document
    field = lambda name: [F.lit(name).alias("field")]
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    order = F.col("__order")
    rules = [
        ("V1", level.isNull(), F.lit("level is null"), order, field("level")),
        ("V2", low, said("level ", level.cast("string"), " is below 1"), order, field("level")),
        ("V3", ~low & (F.col("__prev_level") > 0) & (level > F.col("__prev_level") + 1), said("level ", level.cast("string"), " follows level ", F.col("__prev_level").cast("string")), order, field("level")),
        ("V4", document & (_text("content") != ""), F.lit("a document root has content"), order, field("content")),
        ("V5", (kind != "") & ~kind.isin(KINDS), said("unknown kind ", kind), order, field("kind")),
        ("V6", etype == "", F.lit("no element type"), order, field("element_type")),
        ("V7", (_text("encoding") != "") & ~_text("encoding").isin(ENCODINGS), said("unknown encoding ", _text("encoding")), order, field("encoding")),
        ("V8", order < 0, F.lit("order is null or negative"), order, field("element_order")),
        ("V9", F.col("element_order").isNotNull() & (order >= 0) & (F.col("__nth") > 1), said("order ", order.cast("string"), " stands twice"), order, field("element_order")),
        ("L1", F.when(F.col("__start"), order != 0).otherwise(order != F.col("__last_order") + 1), F.lit("orders must run from 0 without gaps"), order, field("list")),
        ("L2", (F.col("__min_level") > 1) & (F.col("pos") == F.col("__min_pos")), said("the top level is ", F.col("__min_level").cast("string")), order, field("list")),
        ("L6", (kind == "inline") & (depth(level) == F.col("__scope")), F.lit("an inline stands at the level of the value before it"), order, field("list")),
        ("L4", (kind == "block") & stray, said(etype, " stands outside of what it belongs in"), order, field("list")),
        ("L5", (kind == "inline") & stray, F.lit("an inline stands outside of any block or value"), order, field("list")),
    ]
    return _findings(marked, doc_cols, rules, ["field"])


def validity(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """One row for each document: ``valid`` and ``n_errors``."""
    errors = validate(rows, doc_cols).groupBy(*doc_cols).agg(F.count(F.lit(1)).alias("n"))
    docs = rows.select(*doc_cols).distinct()
    return docs.join(errors, doc_cols, "left").select(*doc_cols, F.col("n").isNull().alias("valid"), F.coalesce("n", F.lit(0)).alias("n_errors"))


def lint(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """Findings that aren't errors: (element_order, rule, severity, message), fifteen rules."""
    run = by_document(doc_cols)
    whole = Window.partitionBy(*doc_cols)
    kind, etype, content = _text("kind"), _text("element_type"), _text("content")
    level = depth(F.col("level"))
    heading = etype == "heading"
    rank = rank_of(F.col("attributes"), F.col("level"))
    after = run.rowsBetween(1, Window.unboundedFollowing)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    top_block = (kind == "block") & (F.coalesce("level", F.lit(0)) == 1)
    order = F.coalesce("element_order", F.lit(0))
    marked = rows.withColumns({
        "__after": F.lead(level).over(run),
        "__next_block": F.first(F.when(kind == "block", level), ignorenulls=True).over(after),
        "__prev_rank": F.last(F.when(heading, rank), ignorenulls=True).over(earlier),
        "__before": F.lag(F.struct("kind", "content", "level")).over(run),
        "__prev_order": F.lag(order).over(run),
        "__body": F.min(F.when(top_block & (etype != "metadata"), order)).over(whole),
        "__value": F.min(F.when(kind == "value", order)).over(whole),
    })
    related = Related(marked, doc_cols, {"inline": kind == "inline", "block": kind == "block"})
    marked = related.df
    container = (kind == "block") & (content == "") & etype.isin(CONTAINER_TYPES)
    childless = container & F.col("__next_block").isNotNull() & (F.col("__next_block") <= level)
    empty = (content == "") & ~etype.isin(CONTENTLESS_TYPES) & (etype != "") & (F.col("__after").isNull() | (F.col("__after") <= level))
    # told once: not here if rule 2 tells it, which it does while the next row is a block
    covered = container & F.col("__after").isNotNull()
    plain_parent = (F.col("__before")["kind"] == "block") & (F.coalesce(F.col("__before")["content"], F.lit("")) == "") & (F.col("__before")["level"] == F.col("level") - 1)
    has_sibling = F.coalesce(related.following("block") & (F.col("__next_level") == F.col("level")), F.lit(False))
    rules = [
        ("empty_element", empty & ~covered, "info", F.concat(F.lit("empty "), etype)),
        ("childless_container", childless, "warning", F.concat(etype, F.lit(" has no children; the next block is beside it or above"))),
        ("block_in_inline", (kind == "block") & related.parent("inline"), "warning", F.concat(etype, F.lit(" lies inside an inline"))),
        ("rank_skipped", heading & (F.col("__prev_rank") > 0) & (rank > F.col("__prev_rank") + 1), "warning", F.concat(F.lit("heading of rank "), rank.cast("string"), F.lit(" follows one of rank "), F.col("__prev_rank").cast("string"))),
        ("rank_missing", heading & (_attr("heading_level") == ""), "warning", F.lit("heading without a rank")),
        ("generic_source", (etype == "generic") & (_attr("source_type") == ""), "warning", F.lit("generic element without its source type")),
        ("lone_plain", (etype == "plain") & (kind == "block") & (F.col("level") > 1) & plain_parent & ~has_sibling, "warning", F.lit("a lone plain block; its text belongs in its container")),
        ("unknown_type", (etype != "") & ~etype.isin(ALL_TYPES), "warning", F.concat(F.lit("type outside the vocabulary: "), etype)),
        ("table_schema", (etype == "table") & (content != "") & ~content.contains('"headers"'), "warning", F.lit("table content without headers")),
        ("list_content", (etype == "list") & (content != ""), "warning", F.lit("list carries content of its own")),
        ("deflist", etype == "deflist", "warning", F.lit("deflist is superseded")),
        ("code_language", (etype == "code") & (_attr("language") == ""), "info", F.lit("code without a language")),
        ("order_gap", (F.col("__prev_order") >= 0) & (order > F.col("__prev_order") + 10), "info", F.lit("large gap in orders")),
        ("late_frontmatter", (etype == "metadata") & (_attr("role") == "frontmatter") & (F.col("__body") < order), "warning", F.lit("front matter after the body's start")),
        ("block_after_value", top_block & (F.col("__value") < order), "warning", F.lit("top-level block after a value")),
    ]
    return _findings(marked, doc_cols, [(r, holds, message, order, [F.lit(severity).alias("severity")]) for r, holds, severity, message in rules], ["severity"])


def quality(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """What conforms and still reads badly: (element_order, rule, message), by order and not by place.

    empty_section: the element of the next larger order is a heading of the
    same rank or above. duplicate_heading: text and rank stand more than once,
    told at the first. link_without_text: an empty link with nothing inside. Of
    elements that share an order the first in the list counts as the next one;
    nothing comes after a null order.
    """
    larger = Window.partitionBy(*doc_cols).orderBy(F.coalesce("element_order", F.lit(-(1 << 31))).cast("long")).rangeBetween(1, Window.unboundedFollowing)
    rank = F.round(F.try_element_at("attributes", F.lit("heading_level")).try_cast("double")).try_cast("int")
    marked = rows.withColumns({
        "__rank": rank,
        "__next": F.when(F.col("element_order").isNotNull(), F.min(F.struct("element_order", "pos", "element_type", rank.alias("rank"))).over(larger)),
        "__inside": F.when(F.col("element_order").isNotNull(), F.min(F.when(F.col("level").isNotNull(), F.struct("element_order", "level"))).over(larger)),
    })
    same = Window.partitionBy(*doc_cols, "content", "__rank")
    heading = F.col("element_type") == "heading"
    marked = marked.withColumns({
        "__times": F.sum(heading.cast("int")).over(same),
        "__first": F.min(F.when(heading, F.col("element_order"))).over(same),
    })
    content = _text("content")
    rules = [
        ("empty_section", heading & (F.col("__next")["element_type"] == "heading") & (F.col("__next")["rank"] <= F.col("__rank")), F.lit("section without body or subsections"), F.col("element_order"), []),
        ("duplicate_heading", heading & (content != "") & (F.col("__times") > 1) & (F.col("element_order") == F.col("__first")), F.concat(F.lit("heading text stands "), F.col("__times").cast("string"), F.lit(" times")), F.col("element_order"), []),
        ("link_without_text", (F.col("element_type") == "link") & (content == "") & ~F.coalesce(F.col("__inside")["level"] > F.col("level"), F.lit(False)), F.lit("link without text"), F.col("element_order"), []),
    ]
    return _findings(marked, doc_cols, rules, [])


def stats(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """Per document and type: ``count``, ``total_content_length`` and ``avg_content_length``, in bytes of UTF-8."""
    size = F.octet_length(_text("content"))
    return rows.withColumn("element_type", _text("element_type")).groupBy(*doc_cols, "element_type").agg(F.count(F.lit(1)).alias("count"), F.sum(size).alias("total_content_length"), F.avg(size).alias("avg_content_length"))


def structure(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """One row of eleven counters for each document; types are counted by name, whatever their kind."""
    etype = F.col("element_type")
    many = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    rank = F.when(etype == "heading", rank_of(F.col("attributes"), F.col("level")))
    return rows.groupBy(*doc_cols).agg(
        many(F.col("kind") == "block").alias("block_count"), many(F.col("kind") == "inline").alias("inline_count"), many(etype == "heading").alias("heading_count"),
        many(etype.isin("paragraph", "plain")).alias("paragraph_count"), many(etype == "code").alias("code_count"), many(etype == "list").alias("list_count"),
        many(etype == "link").alias("link_count"), many(etype == "image").alias("image_count"), F.coalesce(F.min(rank), F.lit(0)).alias("min_heading_level"),
        F.coalesce(F.max(rank), F.lit(0)).alias("max_heading_level"), F.sum(F.octet_length(_text("content"))).alias("total_content_length"),
    )


__all__ = ["lint", "quality", "stats", "structure", "validate", "validity"]
