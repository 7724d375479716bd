"""The compact line format: one JSON object for each element.

Fields: ``t`` type code, or ``kind:element_type`` for a type without one; ``c``
content unless null; ``l`` level; ``e`` encoding unless ``text`` (``json`` is
``j``); ``a`` attributes that have a code; ``m`` other attributes. A line with
``@`` and no ``t`` is a header, wherever it stands, and blank lines don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.schema import DDL, FIELDS, LIST_DDL

# Fixed values of the format.
TABLE_VERSION = "4.2.0"
TYPE_CODES = {
    "block": {
        "O": "document", "H": "heading", "P": "paragraph", "N": "plain", "C": "code", "Q": "blockquote", "L": "list", "I": "list_item",
        "E": "deflist", "B": "lineblock", "X": "generic", "T": "table", "R": "hr", "K": "page_break", "M": "metadata", "G": "image",
        "W": "raw", "D": "div", "S": "section", "F": "figure", "A": "caption",
    },
    "inline": {
        "t": "text", "s": "space", "j": "softbreak", "r": "linebreak", "c": "code", "m": "math", "w": "raw", "b": "bold", "q": "quoted",
        "e": "cite", "x": "generic", "i": "italic", "k": "strikethrough", "u": "superscript", "d": "subscript", "z": "smallcaps",
        "l": "underline", "a": "link", "g": "image", "p": "span", "f": "note",
    },
    "value": {"$": "string", "?": "bool", "[": "list", "{": "map", "~": "inlines", "#": "blocks", "@": "version", "*": "generic"},
}
ATTRIBUTE_CODES = {
    "c": "class", "i": "id", "s": "source_type", "h": "heading_level", "t": "list_type", "o": "ordered", "d": "number_delim",
    "k": "key", "r": "role", "w": "href", "f": "format", "u": "src", "g": "language", "y": "number_style",
    "n": "start", "m": "template_name", "a": "alt", "l": "link_type", "p": "pandoc_ast", "x": "execution_count", "e": "title",
}
LINE = "`@` string, t string, c string, l int, e string, a map<string,string>, m map<string,string>"

_CODE_OF = {f"{kind}:{name}": code for kind, codes in TYPE_CODES.items() for code, name in codes.items()}
_TYPE_OF = {code: name for name, code in _CODE_OF.items()}
_KEY_CODE = {key: code for code, key in ATTRIBUTE_CODES.items()}


def _mapped(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _json(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("c")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def _pairs(entries: Column, code: bool) -> Column:
    key = lambda k: F.try_element_at(_mapped(_KEY_CODE), k)
    return F.array_join(F.transform(entries, lambda e: F.concat(_json(key(e["key"]) if code else e["key"]), F.lit(":"), _json(e["value"]))), ",")


def refusal(b: Column) -> Column:
    """Why an element has no line, or null if it has: a null level, encoding, attributes or attribute value, an encoding ``t`` or ``j``."""
    wrong = F.when(b["level"].isNull(), "null level").when(b["encoding"].isNull(), "null encoding").when(b["encoding"].isin("t", "j"), "encoding is a reserved code")
    return wrong.when(b["attributes"].isNull(), "null attributes").when(F.exists(F.map_values(b["attributes"]), lambda v: v.isNull()), "null attribute value")


def line(b: Column) -> Column:
    """An element as a line, without its end. Raises an error where there is a :func:`refusal`."""
    name = F.concat(b["kind"], F.lit(":"), b["element_type"])
    entries = F.map_entries(b["attributes"])
    known = F.filter(entries, lambda e: e["key"].isin(list(_KEY_CODE)))
    other = F.filter(entries, lambda e: ~e["key"].isin(list(_KEY_CODE)))
    why = refusal(b)
    error = F.raise_error(F.concat(F.lit("compact: "), why, F.lit(" at element_order "), F.coalesce(b["element_order"].cast("string"), F.lit("null"))))
    fields = [
        F.concat(F.lit('"t":'), _json(F.coalesce(F.try_element_at(_mapped(_CODE_OF), name), name))),
        F.when(b["content"].isNotNull(), F.concat(F.lit('"c":'), _json(b["content"]))),
        F.concat(F.lit('"l":'), b["level"].cast("string")),
        F.when(b["encoding"] == "json", F.lit('"e":"j"')).when(b["encoding"] != "text", F.concat(F.lit('"e":'), _json(b["encoding"]))),
        F.when(F.size(known) > 0, F.concat(F.lit('"a":{'), _pairs(known, True), F.lit("}"))),
        F.when(F.size(other) > 0, F.concat(F.lit('"m":{'), _pairs(other, False), F.lit("}"))),
    ]
    return F.when(why.isNotNull(), error.cast("string")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))


def header() -> Column:
    return F.concat(F.lit('{"@":'), F.lit(f'"{TABLE_VERSION}"'), F.lit("}"))


def to_compact(blocks: Column) -> Column:
    """A list of elements as text: the header and a line each, by order and then place. Null gives null."""
    placed = F.transform(F.filter(blocks, lambda b: b.isNotNull()), lambda b, i: F.struct(F.coalesce(b["element_order"], F.lit(0)).alias("o"), i.alias("i"), b.alias("b")))
    by = F.array_sort(placed, lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(x["i"] - y["i"]))
    lines = F.transform(by, lambda x: line(x["b"]))
    return F.when(blocks.isNotNull(), F.concat(F.array_join(F.concat(F.array(header()), lines), "\n"), F.lit("\n")))


def _is_header(j: Column) -> Column:
    return j["t"].isNull() & j["@"].isNotNull()


def refused(j: Column) -> Column:
    """Why a parsed line is none of the format's, or null if it is."""
    known = F.try_element_at(_mapped(_TYPE_OF), F.coalesce(j["t"], F.lit(""))).isNotNull() | F.coalesce(j["t"].contains(":"), F.lit(False))
    codes = F.forall(F.map_keys(F.coalesce(j["a"], F.create_map().cast("map<string,string>"))), lambda k: k.isin(list(ATTRIBUTE_CODES)))
    return F.when(~known, "unknown type code").when(~codes, "unknown attribute code").when(j["l"].isNull(), "missing level")


def check(j: Column) -> Column:
    """True for a line that the format allows; raises an error where it is :func:`refused`. Use it as a filter, which no projection can prune."""
    why = refused(j)
    return F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("compact: "), why)).cast("boolean")).otherwise(F.lit(True))


def decoded(j: Column, order: Column) -> Column:
    """The element of a parsed line; attributes come sorted by key."""
    name = F.coalesce(F.try_element_at(_mapped(_TYPE_OF), j["t"]), j["t"])
    at = F.locate(":", name)
    empty = F.create_map().cast("map<string,string>")
    coded = F.map_filter(F.transform_keys(F.coalesce(j["a"], empty), lambda k, _: F.coalesce(F.try_element_at(_mapped(ATTRIBUTE_CODES), k), k)), lambda _, v: v.isNotNull())
    own = F.map_filter(F.coalesce(j["m"], empty), lambda k, _: ~F.map_contains_key(coded, k))
    entries = F.array_sort(F.map_entries(F.map_concat(own, coded)), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.struct(
        name.substr(F.lit(1), at - 1).alias("kind"), name.substr(at + 1, F.length(name)).alias("element_type"), j["c"].alias("content"), j["l"].alias("level"),
        F.when(F.coalesce(j["e"], F.lit("t")) == "t", "text").when(j["e"] == "j", "json").otherwise(j["e"]).alias("encoding"),
        F.map_from_entries(entries).alias("attributes"), order.cast("int").alias("element_order"),
    ).cast(DDL)


def from_compact(text: Column) -> Column:
    """The list of elements of a text in the format; null gives null. Refuses what :func:`check` refuses."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    parsed = F.filter(F.transform(lines, lambda x: F.from_json(x, LINE)), lambda j: ~_is_header(j))
    return F.transform(F.filter(parsed, check), decoded).cast(LIST_DDL)


def read_compact(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files in the format, in row form with ``filename``: one row for each element, ``element_order`` (and ``pos``) by line.

    Splits are read by themselves. A split's lines are numbered within it, and
    the lines of earlier splits of its file are added: what is shuffled by
    split is never more than a split, and what is summed is a number a split.
    """
    raw = spark.read.text(path)
    parsed = raw.select(F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("v"))
    j = parsed.where("v <> ''").withColumn("j", F.from_json("v", LINE)).where(~_is_header(F.col("j"))).where(check(F.col("j")))
    counts = j.groupBy("filename", "split").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("filename").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("filename", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("filename", "split").orderBy("at")
    numbered = j.withColumn("n", F.row_number().over(inside) - 1).join(offsets, ["filename", "split"])
    element = decoded(F.col("j"), F.col("n") + F.col("before"))
    return numbered.select("filename", element.alias("b")).select("filename", F.col("b.element_order").alias("pos"), *[F.col("b")[f].alias(f) for f in FIELDS])


def write_compact(docs: DataFrame, path: str, blocks_col: str = "blocks", mode: str = "errorifexists") -> None:
    """Each list of elements as its header and lines, one document after the other within each file."""
    docs.where(F.col(blocks_col).isNotNull()).select(F.regexp_replace(to_compact(F.col(blocks_col)), "\n$", "").alias("value")).write.mode(mode).text(path)
