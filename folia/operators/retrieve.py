"""Sections, pages and searches: spans of orders, and the elements that lie in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.operators import outline
from folia.operators.text import headings, texts, to_text
from folia.operators.tree import in_order
from folia.schema import FIELDS, LIST_DDL
from folia.vocabulary import MAX_INT


def _ilike(text: Column, term: str) -> Column:
    """Case-insensitive containment, ``%`` and ``_`` being wildcards; no character escapes them."""
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{term}%")
    return text.rlike(f"(?isu)^{pattern}$")


#: Of an element that stands for an empty span: it has no text.
_STAND_IN = {"pos": -1, "kind": "block", "element_type": "hr", "level": 1, "encoding": "text", "element_order": 0}


def in_spans(rows: DataFrame, spans: DataFrame, doc_cols: list[str], start: str, end: str, carry: list[str], empty: bool = False, front: bool = False) -> DataFrame:
    """The rows whose order lies in a span of their document, with columns of the span as ``span_...``.

    Spans of a document mustn't overlap, but may be empty. Each row takes the
    last span that begins at its order or before, in one window over rows and
    spans together, so that rows aren't paired with spans. ``empty``: each span
    also gives a row of its own, a rule with ``pos`` -1. ``front``: rows from
    order 0 on that lie before all spans are kept, with nulls for the span.
    """
    order = F.coalesce("element_order", F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    span = "struct<" + ",".join(f"c{i}:{kinds[c]}" for i, c in enumerate([end, *carry])) + ">"
    own = rows.select(*doc_cols, order.alias("__at"), F.lit(True).alias("__row"), F.struct("pos", *FIELDS).alias("__r"), F.lit(None).cast(span).alias("__c"))
    marks = spans.select(*doc_cols, F.col(start).alias("__at"), F.lit(False).alias("__row"), F.lit(None).cast(own.schema["__r"].dataType).alias("__r"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([end, *carry])]).alias("__c"))
    before = Window.partitionBy(*doc_cols).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(~F.col("__row") & (F.col("__at") <= F.col("__c.c0")), F.col("__c")), ignorenulls=True).over(before)
    met = own.unionByName(marks).withColumn("__s", F.when(F.col("__row"), last).otherwise(F.col("__c")))
    kept = F.col("__row") & F.coalesce(F.col("__at") <= F.col("__s.c0"), F.lit(False))
    if empty:
        kept = kept | ~F.col("__row")
    if front:
        kept = kept | (F.col("__row") & F.col("__s").isNull() & (F.col("__at") >= 0))
    field = lambda f: F.when(F.col("__row"), F.col("__r")[f]).otherwise(F.lit(_STAND_IN.get(f))).alias(f)
    return met.where(kept).select(*doc_cols, *[F.col("__s")[f"c{i + 1}"].alias(f"span_{c}") for i, c in enumerate(carry)], *[field(f) for f in ("pos", *FIELDS)])


def _ends(firsts: list[bool], orders: list[int], ranks: list[int]) -> list[list]:
    """For each heading the order of the next one of its rank or above, less one; the largest number without one."""
    ends = [MAX_INT] * len(orders)
    stack: list[int] = []
    for i, first in enumerate(firsts):
        if first:
            stack = []
        waiting = []
        while stack and (ranks[stack[-1]] >= ranks[i]):
            j = stack.pop()
            if orders[j] < orders[i]:
                ends[j] = orders[i] - 1
            else:  # of the same order: it waits for a larger one
                waiting.append(j)
        stack.extend(reversed(waiting))
        stack.append(i)
    return [ends]


def get_section(rows: DataFrame, doc_cols: list[str], pattern: str) -> DataFrame:
    """The rows of the sections whose title matches or whose id is ``pattern``, subsections included.

    A match inside another match isn't repeated; orders stay. A document without
    a match has no rows.
    """
    h = headings(rows, doc_cols).select(*doc_cols, "pos", "level", F.col("element_order").alias("ord"), (_ilike(F.col("title"), pattern) | (F.col("id") == pattern)).alias("hit"))
    spans = in_order(h, doc_cols, {"ord": F.col("ord"), "level": F.col("level")}, "end int", _ends, ["ord", "pos"]).where("hit").groupBy(*doc_cols, "ord").agg(F.min("end").alias("end"))
    before = Window.partitionBy(*doc_cols).orderBy("ord", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    top = spans.withColumn("__prev", F.max("end").over(before)).where("__prev is null or __prev < end")
    return in_spans(rows, top, doc_cols, "ord", "end", []).select(*doc_cols, "pos", *FIELDS)


def get_section_text(rows: DataFrame, doc_cols: list[str], pattern: str) -> DataFrame:
    """The text of :func:`get_section`, one row for each document with a match."""
    return to_text(get_section(rows, doc_cols, pattern), doc_cols)


def _packed() -> Column:
    """An aggregate: the list form of the elements of some rows."""
    real = F.when(F.col("pos") >= 0, F.struct("pos", F.struct(*FIELDS).alias("b")))
    return F.transform(F.array_sort(F.collect_list(real), lambda a, b: a["pos"] - b["pos"]), lambda x: x["b"]).cast(LIST_DDL)


def sections_with_content(rows: DataFrame, doc_cols: list[str], blocks: bool = False) -> DataFrame:
    """Sections with ``content`` (their own text) and, if asked, ``blocks`` (their own elements, empty if there are none).

    Where headings' orders don't rise, a row belongs to the section that begins
    last at its order or before.
    """
    found = outline.sections(rows, doc_cols)
    columns = [c for c in found.columns if c not in doc_cols]
    key = [*doc_cols, *[f"span_{c}" for c in columns]]
    own = in_spans(rows, found, doc_cols, "content_start_order", "end_order", columns, empty=True)
    out = to_text(own, key, out="content")
    if blocks:
        packed = own.groupBy(*key).agg(_packed().alias("blocks"))
        same = packed.withColumnsRenamed({c: f"__{c}" for c in key})
        on = F.lit(True)
        for c in key:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = out.join(same, on).select(*key, "content", "blocks")
    return out.withColumnsRenamed({f"span_{c}": c for c in columns})


def sections_like(rows: DataFrame, doc_cols: list[str], term: str, blocks: bool = False) -> DataFrame:
    """Sections (to the next heading, with the preamble) whose text contains ``term``: ``section``, ``start_order`` and text or blocks.

    What comes before the first heading is ``(preamble)``; it is told only if
    there is something.
    """
    h = headings(rows, doc_cols).select(*doc_cols, F.col("title").alias("section"), F.col("element_order").alias("s"))
    spans = h.withColumn("e", F.coalesce(F.lead("s").over(Window.partitionBy(*doc_cols).orderBy("s")) - 1, F.lit(MAX_INT)))
    inside = in_spans(rows, spans, doc_cols, "s", "e", ["section", "s"], front=True)
    inside = inside.withColumns({"span_section": F.when(F.col("span_s").isNull(), "(preamble)").otherwise(F.coalesce("span_section", F.lit(""))), "span_s": F.coalesce("span_s", F.lit(0))})
    key = [*doc_cols, "span_section", "span_s"]
    match = texts(inside, key, {"__m": " ", "content": "\n\n"}).where(_ilike(F.col("__m"), term))
    if blocks:
        match = match.join(inside.groupBy(*key).agg(_packed().alias("blocks")), key)
    return match.select(*doc_cols, F.col("span_section").alias("section"), F.col("span_s").alias("start_order"), "blocks" if blocks else "content")


def _page_spans(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """(page_number, start_order, end_order) of every page, the front matter before the first break without a number."""
    breaks = rows.where("kind = 'block' and element_type = 'page_break'").select(*doc_cols, F.coalesce("element_order", F.lit(0)).alias("s"), F.try_element_at("attributes", F.lit("page_number")).alias("given"))
    by = Window.partitionBy(*doc_cols).orderBy("s")
    number = F.coalesce(F.round(F.col("given").try_cast("double")).try_cast("int"), F.row_number().over(by))
    pages = breaks.select(*doc_cols, number.alias("page_number"), F.col("s").alias("start_order"), F.coalesce(F.lead("s").over(by) - 1, F.lit(MAX_INT)).alias("end_order"))
    front = breaks.groupBy(*doc_cols).agg(F.min("s").alias("first")).where("first > 0").select(*doc_cols, F.lit(None).cast("int").alias("page_number"), F.lit(0).alias("start_order"), (F.col("first") - 1).alias("end_order"))
    return pages.unionByName(front)


def page_rows(rows: DataFrame, doc_cols: list[str], blocks: bool = False) -> DataFrame:
    """Pages with ``block_count`` (elements) and, if asked, ``blocks``. Documents without page breaks have no rows."""
    columns = ["page_number", "start_order", "end_order"]
    inside = in_spans(rows, _page_spans(rows, doc_cols), doc_cols, "start_order", "end_order", columns, empty=True).withColumnsRenamed({f"span_{c}": c for c in columns})
    more = [_packed().alias("blocks")] if blocks else []
    return inside.groupBy(*doc_cols, *columns).agg(F.count_if(F.col("pos") >= 0).alias("block_count"), *more)


def get_pages(rows: DataFrame, doc_cols: list[str], first: int, last: int) -> DataFrame:
    """The rows from the start of the first to the end of the last of the pages numbered ``first`` to ``last``."""
    span = _page_spans(rows, doc_cols).where(F.col("page_number").between(first, last)).groupBy(*doc_cols).agg(F.min("start_order").alias("s"), F.max("end_order").alias("e"))
    return in_spans(rows, span, doc_cols, "s", "e", []).select(*doc_cols, "pos", *FIELDS)


def get_pages_text(rows: DataFrame, doc_cols: list[str], first: int, last: int) -> DataFrame:
    """The text of :func:`get_pages`, one row for each document with such pages."""
    return to_text(get_pages(rows, doc_cols, first, last), doc_cols)


def diff(before: DataFrame, after: DataFrame, doc_cols: list[str]) -> DataFrame:
    """What changed between two versions of documents: (change, element_type, content, n, before_level, after_level).

    Elements are the same if type and content (null as empty) are. ADDED and
    REMOVED count the difference in number; MOVED says that as many are there
    but the smallest level differs.
    """
    key = [*doc_cols, "element_type", "content"]

    def counted(rows: DataFrame, side: str) -> DataFrame:
        return rows.withColumn("content", F.coalesce("content", F.lit(""))).groupBy(*key).agg(F.min("level").alias(f"{side}_level"), F.count(F.lit(1)).alias(f"{side}_n"))

    both = counted(before, "before").join(counted(after, "after"), key, "full_outer").withColumns({"bn": F.coalesce("before_n", F.lit(0)), "an": F.coalesce("after_n", F.lit(0))})
    change = F.when(F.col("an") > F.col("bn"), "ADDED").when(F.col("bn") > F.col("an"), "REMOVED").when(~F.col("before_level").eqNullSafe(F.col("after_level")), "MOVED")
    n = F.when(F.col("an") == F.col("bn"), F.col("bn")).otherwise(F.abs(F.col("an") - F.col("bn")))
    return both.withColumn("change", change).where("change is not null").select(*doc_cols, "change", "element_type", "content", n.alias("n"), "before_level", "after_level")
