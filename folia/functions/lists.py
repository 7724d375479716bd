"""Column functions over the list form: assembling, slicing, filtering, renumbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.schema import DDL, LIST_DDL, element, empty_list
from folia.vocabulary import SPEC_VERSION


def _col(value, kind: str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(kind)


def live(blocks: Column) -> Column:
    """Without null elements."""
    return F.filter(blocks, lambda b: b.isNotNull())


def renumbered(blocks: Column, first: int = 0) -> Column:
    """Orders by place in the list."""
    return F.transform(blocks, lambda b, i: b.withField("element_order", (i + first).cast("int")))


def assemble(blocks: Column, nested: bool = False) -> Column:
    """Drops nulls and numbers the rest from 0; ``nested``: a list of lists is joined first. Null gives null."""
    if nested:
        blocks = F.flatten(F.filter(blocks, lambda x: x.isNotNull()))
    return renumbered(live(blocks))


def concat(first: Column, second: Column) -> Column:
    """Both lists as they are, nulls dropped; a null list is empty."""
    return live(F.concat(F.coalesce(first, empty_list()), F.coalesce(second, empty_list())))


def merge(first: Column, second: Column) -> Column:
    """Both lists, the second's orders following the first's largest. Null if both are."""
    top = F.coalesce(F.array_max(F.transform(live(first), lambda b: F.coalesce(b["element_order"], F.lit(0)))), F.lit(-1))
    moved = F.transform(live(F.coalesce(second, empty_list())), lambda b: b.withField("element_order", F.coalesce(b["element_order"], F.lit(0)) + top + 1))
    return F.when(first.isNotNull() | second.isNotNull(), F.concat(live(F.coalesce(first, empty_list())), moved))


def keep_types(blocks: Column, types: Column | list[str]) -> Column:
    """Elements whose type is in the set, whatever their kind and children. Null if either is null."""
    wanted = types if isinstance(types, Column) else F.array(*[F.lit(t) for t in types]).cast("array<string>")
    return F.when(wanted.isNotNull(), F.filter(blocks, lambda b: b.isNotNull() & F.array_contains(F.filter(wanted, lambda t: t.isNotNull()), F.coalesce(b["element_type"], F.lit("")))))


def drop_types(blocks: Column, types: Column | list[str]) -> Column:
    """The complement of :func:`keep_types`."""
    wanted = types if isinstance(types, Column) else F.array(*[F.lit(t) for t in types]).cast("array<string>")
    return F.when(wanted.isNotNull(), F.filter(blocks, lambda b: b.isNotNull() & ~F.array_contains(F.filter(wanted, lambda t: t.isNotNull()), F.coalesce(b["element_type"], F.lit("")))))


def reorder(blocks: Column) -> Column:
    """Sorted by order (null as 0, ties by place) and numbered from 0."""
    placed = F.transform(live(blocks), lambda b, i: F.struct(F.coalesce(b["element_order"], F.lit(0)).alias("o"), i.alias("i"), b.alias("b")))
    by = F.array_sort(placed, lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(x["i"] - y["i"]))
    return renumbered(F.transform(by, lambda x: x["b"]))


def slice_orders(blocks: Column, start, end) -> Column:
    """Elements whose order lies in [start, end]. Null if any argument is null."""
    start, end = _col(start, "int"), _col(end, "int")
    return F.when(start.isNotNull() & end.isNotNull(), F.filter(blocks, lambda b: b.isNotNull() & F.coalesce(b["element_order"], F.lit(0)).between(start, end)))


def rank_of(attrs: Column, level: Column) -> Column:
    """A heading's rank: its attribute as leading digits, else its level, else 1."""
    given = F.coalesce(F.try_element_at(attrs, F.lit("heading_level")), F.lit(""))
    number = F.nullif(F.regexp_extract(given, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(number, level, F.lit(1))


def rebase_levels(blocks: Column, offset) -> Column:
    """Headings' ranks moved by an offset (null as 0), kept within 1 to 6; ranks of 0 or less stay."""
    offset = F.coalesce(_col(offset, "int"), F.lit(0))

    def moved(b: Column) -> Column:
        rank = rank_of(b["attributes"], b["level"])
        new = F.greatest(F.lit(1), F.least(F.lit(6), rank + offset)).cast("string")
        others = F.map_filter(F.coalesce(b["attributes"], F.create_map().cast("map<string,string>")), lambda k, _: k != "heading_level")
        changed = b.withField("attributes", F.map_concat(others, F.create_map(F.lit("heading_level"), new)))
        return F.when((b["element_type"] == "heading") & (rank > 0), changed).otherwise(b)

    return F.transform(live(blocks), moved)


def stamp(blocks: Column) -> Column:
    """With a version element of the model's version behind the last; null gives null."""
    top = F.coalesce(F.array_max(F.transform(live(blocks), lambda b: F.coalesce(b["element_order"], F.lit(0)))), F.lit(-1))
    return F.when(blocks.isNotNull(), F.concat(blocks.cast(LIST_DDL), F.array(element("value", "version", SPEC_VERSION, order=top + 1))))


def version(blocks: Column) -> Column:
    """The content of the first version element, null without one."""
    return F.get(F.filter(blocks, lambda b: (b["kind"] == "value") & (b["element_type"] == "version")), F.lit(0))["content"]


def code_blocks(blocks: Column) -> Column:
    """Code elements of kind block."""
    return F.filter(F.coalesce(blocks, empty_list()), lambda b: F.coalesce((b["kind"] == "block") & (b["element_type"] == "code"), F.lit(False)))


def code_structs(blocks: Column) -> Column:
    """(language, content, element_order) of code elements of any kind; null language reads as empty. Null gives an empty list."""
    code = F.filter(F.coalesce(blocks, empty_list()), lambda b: F.coalesce(b["element_type"] == "code", F.lit(False)))
    return F.transform(code, lambda b: F.struct(F.coalesce(F.try_element_at(b["attributes"], F.lit("language")), F.lit("")).alias("language"), F.coalesce(b["content"], F.lit("")).alias("content"), F.coalesce(b["element_order"], F.lit(0)).alias("element_order")))


def _source(b: Column) -> Column:
    return F.coalesce(F.try_element_at(b["attributes"], F.lit("src")), F.lit(""))


def links(blocks: Column) -> Column:
    """Link elements, and images with a source, as they are."""
    return F.filter(F.coalesce(blocks, empty_list()), lambda b: F.coalesce((b["element_type"] == "link") | ((b["element_type"] == "image") & (_source(b) != "")), F.lit(False)))


def link_structs(blocks: Column) -> Column:
    """(href, text, title, element_order) of :func:`links`; an image's source and content take the first two places."""
    text = lambda b, key: F.coalesce(F.try_element_at(b["attributes"], F.lit(key)), F.lit(""))
    return F.transform(
        links(blocks),
        lambda b: F.struct(
            F.when(b["element_type"] == "image", _source(b)).otherwise(text(b, "href")).alias("href"), F.coalesce(b["content"], F.lit("")).alias("text"),
            text(b, "title").alias("title"), F.coalesce(b["element_order"], F.lit(0)).alias("element_order"),
        ),
    )


__all__ = ["assemble", "code_blocks", "code_structs", "concat", "drop_types", "keep_types", "link_structs", "links", "merge", "rank_of", "rebase_levels", "renumbered", "reorder", "slice_orders", "stamp", "version", "DDL"]
