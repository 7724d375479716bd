"""The element struct, and the two forms of a document.

List form: a column of ``array<struct>``, one document a row. Row form: the
document's key columns, ``pos`` (place in the list, from 0) and the seven
fields, one element a row. Tree walks follow ``pos``; ``element_order`` is a
number that elements carry and may have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ["kind", "element_type", "content", "level", "encoding", "attributes", "element_order"]
DDL = "struct<kind:string,element_type:string,content:string,level:int,encoding:string,attributes:map<string,string>,element_order:int>"
LIST_DDL = f"array<{DDL}>"
ELEMENT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("element_type", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("encoding", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("element_order", T.IntegerType()),
])
LIST = T.ArrayType(ELEMENT)


def empty_list() -> Column:
    return F.array().cast(LIST_DDL)


def null_list() -> Column:
    return F.lit(None).cast(LIST_DDL)


def attributes(**pairs: Column | str | None) -> Column:
    """A map of the pairs whose value isn't null; ``_`` ends a name that Python reserves."""
    entries = []
    for key, value in pairs.items():
        if value is not None:
            entries += [F.lit(key.rstrip("_")), value if isinstance(value, Column) else F.lit(value)]
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).cast("map<string,string>")


def element(kind, element_type, content, level=1, encoding="text", attrs: Column | None = None, order=0) -> Column:
    """One element struct; plain values become literals."""
    col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    attrs = attributes() if attrs is None else attrs
    return F.struct(
        col(kind, "string").alias("kind"), col(element_type, "string").alias("element_type"), col(content, "string").alias("content"), col(level, "int").alias("level"),
        col(encoding, "string").alias("encoding"), attrs.cast("map<string,string>").alias("attributes"), col(order, "int").alias("element_order"),
    )


def accept(blocks: Column, schema: T.DataType) -> Column:
    """A list of elements in the seven-field shape, from that shape or from the one with a trailing ``filename``.

    Raises ``TypeError`` for any other shape.
    """
    if not isinstance(schema, T.ArrayType) or not isinstance(schema.elementType, T.StructType):
        raise TypeError(f"not a list of elements: {schema.simpleString()}")
    found = [(f.name, f.dataType.simpleString()) for f in schema.elementType.fields]
    own = [(f.name, f.dataType.simpleString()) for f in ELEMENT.fields]
    if found not in (own, [*own, ("filename", "string")]):
        raise TypeError(f"not an element: {schema.elementType.simpleString()}")
    return F.transform(blocks, lambda b: F.when(b.isNotNull(), F.struct(*[b[f].alias(f) for f in FIELDS])).otherwise(F.lit(None).cast(DDL)))


def from_text(text: Column) -> Column:
    """A text as an inline text element of level 1; null gives null."""
    return F.when(text.isNotNull(), element("inline", "text", text))


def to_rows(docs: DataFrame, doc_cols: list[str], blocks_col: str = "blocks") -> DataFrame:
    """List form to row form. Null elements keep their place in the count but give no row; null lists give none."""
    opened = docs.select(*doc_cols, F.posexplode(blocks_col).alias("pos", "b"))
    return opened.where("b is not null").select(*doc_cols, "pos", *[F.col("b")[f].alias(f) for f in FIELDS])


def to_list(rows: DataFrame, doc_cols: list[str], out: str = "blocks") -> DataFrame:
    """Row form to list form, by ``pos``. A document is one row, so its elements meet in one task."""
    packed = F.struct("pos", F.struct(*FIELDS).alias("b"))
    ordered = F.array_sort(F.collect_list(packed), lambda a, b: a["pos"] - b["pos"])
    return rows.groupBy(*doc_cols).agg(F.transform(ordered, lambda x: x["b"]).cast(LIST_DDL).alias(out))
