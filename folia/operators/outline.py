"""Outlines: tables of contents, numbering, sections."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.operators.text import headings
from folia.operators.tree import by_document, in_order


def toc(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """Headings with ``indent``, the rank above the document's smallest (7 at most counts as smallest)."""
    least = F.least(F.lit(7), F.min("level").over(Window.partitionBy(*doc_cols)))
    return headings(rows, doc_cols).select(*doc_cols, "level", "title", "id", (F.col("level") - least).alias("indent"), "element_order")


def _labels(firsts: list[bool], ranks: list[int]) -> list[list]:
    """Outline numbers: a counter for each rank that is open. A rank that was passed over keeps its place among those that are open."""
    out, stack = [], []  # stack: [rank, counter]
    for first, rank in zip(firsts, ranks, strict=True):
        if first:
            stack = []
        before = 0
        while stack and stack[-1][0] > rank:
            before = stack.pop()[1]
        if stack and stack[-1][0] == rank:
            stack[-1][1] += 1
        else:
            stack.append([rank, before + 1])
        out.append(".".join(str(n) for _, n in stack))
    return [out]


def outlined(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """Headings with ``outline`` ("1.2.1") and ``indent``, one row each; numbered in one pass over a document's headings."""
    found = headings(rows, doc_cols).withColumn("least", F.least(F.lit(7), F.min("level").over(Window.partitionBy(*doc_cols))))
    numbered = in_order(found, doc_cols, {"level": F.col("level")}, "outline string", _labels)
    return numbered.select(*doc_cols, "pos", "level", "title", "id", "element_order", "attributes", "encoding", "depth", "outline", (F.col("level") - F.col("least")).alias("indent"))


def heading_blocks(rows: DataFrame, doc_cols: list[str], with_indent: bool = False) -> DataFrame:
    """Row form of one heading block for each heading: its flat title, and rank, outline and, if asked, indent as attributes."""
    found = outlined(rows, doc_cols)
    names = ["heading_level", "outline"] + (["indent"] if with_indent else [])
    own = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(names))
    new = [F.lit("heading_level"), F.col("level").cast("string"), F.lit("outline"), F.col("outline")]
    if with_indent:
        new += [F.lit("indent"), F.col("indent").cast("string")]
    return found.select(
        *doc_cols, "pos", F.lit("block").alias("kind"), F.lit("heading").alias("element_type"), F.col("title").alias("content"), F.col("depth").alias("level"),
        F.when(F.coalesce(F.col("encoding"), F.lit("")) == "", "text").otherwise(F.col("encoding")).alias("encoding"), F.map_concat(own, F.create_map(*new)).alias("attributes"), "element_order",
    )


def slug(title: Column) -> Column:
    """Small ASCII letters, digits and underscores; every other stretch is one dash, none at the ends."""
    small = F.translate(title, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.regexp_replace(small, "[^a-z0-9_]+", "-"), "^-+|-+$", "")


def _names(firsts: list[bool], ranks: list[int], slugs: list[str]) -> list[list]:
    """Ids, paths and parents' ids of sections.

    A slug that was counted before takes its count as a suffix; if that was
    counted too, it takes one more. What is counted is the slug with its first
    suffix. The parent is the nearest earlier heading of a smaller rank.
    """
    ids, paths, parents = [], [], []
    counted: dict[str, int] = {}
    stack: list[tuple[int, str, str]] = []
    for first, rank, slug_ in zip(firsts, ranks, slugs, strict=True):
        if first:
            counted, stack = {}, []
        n = counted.get(slug_, 0)
        once = f"{slug_}-{n}" if n else slug_
        n = counted.get(once, 0)
        name = f"{once}-{n}" if n else once
        counted[once] = n + 1
        while stack and stack[-1][0] >= rank:
            stack.pop()
        ids.append(name)
        parents.append(stack[-1][1] if stack else None)
        paths.append(f"{stack[-1][2]}/{name}" if stack else name)
        stack.append((rank, name, paths[-1]))
    return [ids, paths, parents]


def _sectioned(found: DataFrame, doc_cols: list[str], more: list[str]) -> DataFrame:
    """Sections of headings that have ``__last_order``, with further columns of theirs."""
    run = by_document(doc_cols)
    found = found.withColumn("__next", F.lead("element_order").over(run))
    named = in_order(found, doc_cols, {"level": F.col("level"), "slug": slug(F.col("title"))}, "section_id string, section_path string, parent_id string", _names)
    end = F.coalesce(F.col("__next") - 1, F.col("__last_order"))
    return named.select(
        *doc_cols, "section_id", "section_path", "level", "title", "parent_id", F.col("element_order").alias("start_order"), end.alias("end_order"),
        F.coalesce(F.col("body_order"), end + 1).alias("content_start_order"), *more,
    )


def sections(rows: DataFrame, doc_cols: list[str]) -> DataFrame:
    """One row for each section: ``section_id``, ``section_path``, ``level``, ``title``, ``parent_id`` and orders.

    A section's own content ends before the next heading of any level
    (``end_order``; the document's last order for the last one) and starts after
    the title's inlines (``content_start_order``).
    """
    last = F.max(F.coalesce("element_order", F.lit(0))).over(Window.partitionBy(*doc_cols))
    return _sectioned(headings(rows.withColumn("__last_order", last), doc_cols, ["__last_order"]), doc_cols, [])
