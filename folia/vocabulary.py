"""Names and structural predicates of the element model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
SPEC_VERSION = "1.4"
KINDS = ["block", "inline", "value"]
BLOCK_TYPES = [
    "document", "heading", "paragraph", "plain", "code", "blockquote", "list", "list_item", "table", "hr", "metadata",
    "image", "raw", "div", "section", "page_break", "lineblock", "deflist", "figure", "caption", "generic",
]
INLINE_TYPES = [
    "text", "space", "softbreak", "linebreak", "bold", "italic", "strikethrough", "superscript", "subscript",
    "smallcaps", "underline", "code", "math", "link", "image", "quoted", "cite", "note", "span", "raw", "generic",
]
VALUE_TYPES = ["string", "bool", "list", "map", "inlines", "blocks", "version"]
ENCODINGS = ["text", "json", "yaml", "html", "xml", "latex", "markdown", "toml"]
CONTAINER_TYPES = ["div", "section", "figure", "caption", "blockquote", "list", "list_item"]
CONTENTLESS_TYPES = ["hr", "image", "raw", "space", "softbreak", "linebreak"]
CORE_TYPES = ["heading", "paragraph", "code", "blockquote", "list", "table", "hr", "metadata", "image", "raw"]
MAX_INT = 2147483647

ALL_TYPES = list(dict.fromkeys(BLOCK_TYPES + INLINE_TYPES + VALUE_TYPES))


def names(which: list[str]) -> Column:
    """A vocabulary list as an array column."""
    return F.array(*[F.lit(x) for x in which])


def kind_names() -> Column:
    return names(KINDS)


def type_names() -> Column:
    return names(ALL_TYPES)


def encoding_names() -> Column:
    return names(ENCODINGS)


def spec_version() -> Column:
    return F.lit(SPEC_VERSION)


def implicit_parent(element_type: Column, kind: Column) -> Column:
    """The block type that a stray element is wrapped in; null if it needs none."""
    return (
        F.when(kind == "inline", F.lit("plain"))
        .when((kind == "block") & (element_type == "list_item"), F.lit("list"))
        .when((kind == "block") & (element_type == "caption"), F.lit("figure"))
    )


def is_body(kind: Column, element_type: Column) -> Column:
    """Necessary, not sufficient, for an element to belong to the body."""
    return kind.isin("block", "inline") & (element_type != "metadata")


def satisfies_ancestor(element_type: Column, kind: Column, ancestor_type: Column) -> Column:
    """Whether an ancestor of this type is one that the element needs; true if it needs none in particular."""
    return (
        F.when(kind == "inline", F.lit(True))
        .when(element_type == "list_item", ancestor_type.isin("list", "deflist"))
        .when(element_type == "caption", ancestor_type.isin("figure", "table"))
        .otherwise(F.lit(True))
    )
