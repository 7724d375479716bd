"""Constructors and accessors of single elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.schema import DDL, FIELDS, attributes, element
from folia.vocabulary import CORE_TYPES, ENCODINGS


def block(element_type, content, level=1, encoding="text", attrs: Column | None = None, order=0) -> Column:
    """A block with the given fields, as they are."""
    return element("block", element_type, content, level, encoding, attrs, order)


def to_element(value: Column, schema: T.StructType) -> Column:
    """A struct of any field names as an element, by position.

    Seven fields or more are copied in order; of fewer, the first is the type and
    the second the content, and the rest takes defaults. Null gives null.
    """
    parts = [value[f.name] for f in schema.fields]
    if len(parts) >= 7:
        made = F.struct(*[p.alias(f) for p, f in zip(parts, FIELDS, strict=False)]).cast(DDL)
    else:
        made = element("block", parts[0] if parts else F.lit(None), parts[1] if len(parts) > 1 else F.lit(None))
    return F.when(value.isNotNull(), made)


def is_valid(b: Column) -> Column:
    """Whether type, encoding and order are fit for a core block; kind and level aren't looked at."""
    known = F.coalesce(b["element_type"].isin(CORE_TYPES), F.lit(False))
    encoded = F.coalesce(b["encoding"].isin(ENCODINGS) | (b["encoding"] == ""), F.lit(True))
    return F.coalesce(b.isNotNull() & known & encoded & F.coalesce(b["element_order"] >= 0, F.lit(True)), F.lit(False))


def type_of(b: Column) -> Column:
    return b["element_type"]


def content_of(b: Column) -> Column:
    return b["content"]


def level_of(b: Column) -> Column:
    return b["level"]


def encoding_of(b: Column) -> Column:
    return b["encoding"]


def order_of(b: Column) -> Column:
    return b["element_order"]


def attribute(b: Column, key) -> Column:
    """An attribute's value; null if it is missing or empty."""
    return F.nullif(F.try_element_at(b["attributes"], key if isinstance(key, Column) else F.lit(key)), F.lit(""))


def set_order(b: Column, value) -> Column:
    return b.withField("element_order", (value if isinstance(value, Column) else F.lit(value)).cast("int"))


def set_content(b: Column, value) -> Column:
    return b.withField("content", (value if isinstance(value, Column) else F.lit(value)).cast("string"))


def set_level(b: Column, value) -> Column:
    return b.withField("level", (value if isinstance(value, Column) else F.lit(value)).cast("int"))


__all__ = ["attributes", "attribute", "block", "content_of", "encoding_of", "is_valid", "level_of", "order_of", "set_content", "set_level", "set_order", "to_element", "type_of"]
