"""Elements from tables: conversations read as documents.

``conversation_rows``: each turn is a heading ("role turn", rank 1 + turn % 3)
followed by its lines, every fourth from the third a code element, the others
paragraphs. ``nested_rows`` gives the same lines a tree: their order modulo 16
decides kind, type and depth. ``irregular_rows`` gives them what the rules of
conformance and style forbid, and ``deep_rows`` twenty levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.schema import FIELDS

#: Of :func:`nested_rows`: order modulo 16 -> kind, type, level, whether it has content, attribute and value.
SHAPES = [
    ("block", "heading", 1, True, "heading_level", "1"),
    ("block", "paragraph", 1, False, None, None),
    ("inline", "text", 2, True, None, None),
    ("inline", "link", 2, True, "href", "https://example.com/"),
    ("block", "list", 1, False, "list_type", "bullet"),
    ("block", "list_item", 2, False, None, None),
    ("block", "plain", 3, True, None, None),
    ("block", "heading", 1, False, "heading_level", "2"),
    ("inline", "bold", 2, True, None, None),
    ("value", "map", 1, False, "key", "meta"),
    ("value", "string", 2, True, "key", "title"),
    ("inline", "text", 3, True, None, None),
    ("block", "page_break", 1, False, None, None),
    ("block", "caption", 2, True, None, None),
    ("block", "code", 1, True, "language", "sql"),
    ("inline", "text", 3, True, None, None),
]


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row form keyed by ``conv_id``. One shuffle by conversation, which later operators reuse."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    made = lines.select(
        "conv_id", "turn", (F.col("i") + 1).alias("sub"), F.when((F.col("i") + 1) % 4 == 3, "code").otherwise("paragraph").alias("element_type"), "content", F.create_map().cast("map<string,string>").alias("attributes")
    )
    heads = turns.select(
        "conv_id", "turn", F.lit(0).alias("sub"), F.lit("heading").alias("element_type"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("content"),
        F.create_map(F.lit("heading_level"), (1 + F.col("turn") % 3).cast("string")).alias("attributes"),
    )
    by = Window.partitionBy("conv_id").orderBy("turn", "sub")
    order = F.row_number().over(by) - 1
    return heads.unionByName(made).select(
        "conv_id", order.alias("pos"), F.lit("block").alias("kind"), "element_type", "content", F.lit(1).alias("level"), F.lit("text").alias("encoding"), "attributes", order.alias("element_order")
    )


def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of :func:`conversation_rows` with the shapes of ``SHAPES``."""
    rows = conversation_rows(spark, sf_dir)
    shape = F.get(F.array(*[F.struct(*[F.lit(v) for v in (k, t, lv, full)], F.lit(a).cast("string"), F.lit(v).cast("string")).cast("struct<k:string,t:string,l:int,full:boolean,a:string,v:string>") for k, t, lv, full, a, v in SHAPES]), F.col("pos") % len(SHAPES))
    s = rows.withColumn("s", shape)
    attrs = F.when(F.col("s.a").isNotNull(), F.create_map(F.col("s.a"), F.col("s.v"))).otherwise(F.create_map().cast("map<string,string>"))
    return s.select(
        "conv_id", "pos", F.col("s.k").alias("kind"), F.col("s.t").alias("element_type"), F.when(F.col("s.full"), F.col("content")).alias("content"), F.col("s.l").alias("level"), "encoding", attrs.alias("attributes"), "element_order"
    ).select("conv_id", "pos", *FIELDS)


#: Of :func:`irregular_rows`: kind, type, level, content (True: the line), encoding, attribute and value, and what is added to the order (None: no order).
IRREGULAR = [
    ("block", "document", 0, "Root", "text", None, None, 0),
    ("block", "heading", 1, "Same", "text", "heading_level", "1", 0),
    ("block", "heading", 1, "Same", "text", "heading_level", "1", 0),
    ("block", "heading", 1, True, "text", "heading_level", "4", 0),
    ("block", "heading", 1, True, "text", None, None, 0),
    ("block", "paragraph", 1, None, "text", None, None, 0),
    ("inline", "link", 2, "", "text", "href", "https://example.com/", 0),
    ("inline", "link", 2, "here", "text", "href", "https://example.com/", 0),
    ("block", "image", 1, True, "text", "src", "a.png", 0),
    ("block", "list", 1, True, "text", "list_type", "bullet", 0),
    ("block", "list_item", 2, None, "text", None, None, 0),
    ("block", "plain", 3, True, "text", None, None, 0),
    ("block", "div", 1, None, "text", None, None, 0),
    ("block", "table", 1, '{"rows":[["p"]]}', "json", None, None, 0),
    ("block", "table", 1, '{"headers":["a","b"],"rows":[["x",""],["y","z"]]}', "json", None, None, 0),
    ("block", "deflist", 1, None, "text", None, None, 0),
    ("block", "code", 1, True, "text", None, None, 0),
    ("block", "generic", 1, True, "text", None, None, 0),
    ("block", "sidebar", 1, True, "text", None, None, 0),
    ("odd", "paragraph", 1, True, "text", None, None, 0),
    ("block", "", 1, True, "text", None, None, 0),
    ("block", "paragraph", 1, True, "rot13", None, None, 0),
    ("block", "paragraph", None, True, "text", None, None, 0),
    ("block", "paragraph", -1, True, "text", None, None, 0),
    ("block", "paragraph", 1, True, "text", None, None, None),
    ("block", "paragraph", 1, True, "text", None, None, -1),
    ("block", "paragraph", 1, True, "text", None, None, 20),
    ("block", "metadata", 1, True, "yaml", "role", "frontmatter", 0),
    ("block", "list_item", 1, True, "text", None, None, 0),
    ("block", "caption", 2, True, "text", None, None, 0),
    ("inline", "text", 1, True, "text", None, None, 0),
    ("value", "map", 1, None, "text", "key", "meta", 0),
    ("inline", "text", 1, True, "text", None, None, 0),
    ("value", "string", 1, True, "text", "key", "title", 0),
    ("value", "string", 2, True, "text", "key", "sub", 0),
    ("block", "page_break", 1, None, "text", "page_number", "7", 0),
    ("inline", "bold", 3, True, "text", None, None, 0),
    ("block", "div", 4, None, "text", None, None, 0),
    ("block", "raw", 1, True, "text", "format", "tex", 0),
    ("inline", "image", 2, "", "text", "alt", "picture", 0),
]


def irregular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of :func:`conversation_rows` with the shapes of ``IRREGULAR``, from another one on in each conversation; every ninth lies a level deeper."""
    kind = "struct<k:string,t:string,l:int,full:boolean,c:string,e:string,a:string,v:string,o:int>"
    shapes = [F.struct(*[F.lit(v) for v in (k, t, lv, c is True, None if c is True else c, e, a, v, o)]).cast(kind) for k, t, lv, c, e, a, v, o in IRREGULAR]
    s = conversation_rows(spark, sf_dir).withColumn("s", F.get(F.array(*shapes), ((F.col("pos") + 3 * F.col("conv_id")) % len(IRREGULAR)).cast("int")))
    level = F.when(F.col("conv_id") % 9 == 0, F.coalesce("s.l", F.lit(1)) + 1).otherwise(F.col("s.l"))
    attrs = F.when(F.col("s.a").isNotNull(), F.create_map(F.col("s.a"), F.col("s.v"))).otherwise(F.create_map().cast("map<string,string>"))
    return s.select(
        "conv_id", "pos", F.col("s.k").alias("kind"), F.col("s.t").alias("element_type"), F.when(F.col("s.full"), F.col("content")).otherwise(F.col("s.c")).alias("content"), level.alias("level"),
        F.col("s.e").alias("encoding"), attrs.alias("attributes"), (F.col("element_order") + F.col("s.o")).cast("int").alias("element_order"),
    ).select("conv_id", "pos", *FIELDS)


def deep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of :func:`conversation_rows` nested up to twenty levels; every ninth is metadata, with what lies in it."""
    rows = conversation_rows(spark, sf_dir)
    etype = F.when(F.col("pos") % 9 == 4, "metadata").otherwise("div")
    return rows.withColumns({"element_type": etype, "level": (1 + F.col("pos") * 7 % 20).cast("int"), "attributes": F.create_map().cast("map<string,string>")}).select("conv_id", "pos", *FIELDS)
