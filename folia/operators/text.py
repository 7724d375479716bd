"""Text of documents.

A unit is an element that isn't inline, with the run of inlines that follows
it; a run without such an element in front is a unit too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.functions.lists import rank_of
from folia.operators.tree import Related, by_document, heading_scope, is_inline


def inline_text() -> Column:
    """What an inline adds to its run."""
    kind, content = F.col("element_type"), F.coalesce(F.col("content"), F.lit(""))
    alt = F.coalesce(F.try_element_at("attributes", F.lit("alt")), F.lit(""))
    return F.when(kind.isin("space", "softbreak"), " ").when(kind == "linebreak", "\n").when((kind == "image") & (content == ""), alt).otherwise(content)


def _grouped(marked: DataFrame, doc_cols: list[str], hidden: Column, more: list[str]) -> DataFrame:
    """Units of rows that have ``in_value``, by the last element before them that isn't inline; ``more``: columns of that element."""
    run = by_document(doc_cols).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__hidden", hidden).withColumn("__owner", F.coalesce(F.last(F.when(~is_inline(), F.col("pos")), ignorenulls=True).over(run), F.lit(-1)))
    head = F.max_by(F.struct("kind", "element_type", "content", "level", "encoding", "attributes", "element_order", "in_value", F.col("__hidden").alias("hidden"), *more), F.when(~is_inline(), F.col("pos")))
    pieces = F.collect_list(F.when(is_inline(), F.struct("pos", inline_text().alias("t"), F.col("__hidden").alias("h"))))
    grouped = marked.groupBy(*doc_cols, "__owner").agg(head.alias("e"), F.array_sort(pieces, lambda a, b: a["pos"] - b["pos"]).alias("r"), F.min_by("element_order", "pos").alias("first_order"))
    text = F.array_join(F.transform(F.filter("r", lambda x: ~x["h"] | F.col("e").isNotNull()), lambda x: x["t"]), "")
    seen = F.array_join(F.transform(F.filter("r", lambda x: ~x["h"]), lambda x: x["t"]), "")
    block = F.col("e").isNotNull() & ~F.col("e")["hidden"]
    lone = F.col("e").isNull() | F.col("e")["hidden"]
    out = grouped.select(
        *doc_cols, F.col("__owner").alias("pos"), *[F.col("e")[f].alias(f) for f in ("kind", "element_type", "content", "level", "encoding", "attributes", *more)],
        F.coalesce(F.col("e")["element_order"], F.lit(0)).alias("element_order"), F.coalesce(F.col("e")["in_value"], F.lit(False)).alias("in_value"),
        F.when(block, text).otherwise(seen).alias("run"), lone.alias("lone"), F.coalesce("first_order", F.lit(0)).alias("first_order"),
    )
    return out.withColumn("next_order", F.lead("first_order").over(by_document(doc_cols)))


def _hides() -> Column:
    """Whether an element keeps itself and all that is in it out of the body's text."""
    return F.coalesce(~F.col("kind").isin("block", "inline") | ((F.col("kind") == "block") & (F.col("element_type") == "metadata")), F.lit(True))


def units(rows: DataFrame, doc_cols: list[str], more: list[str] | None = None) -> DataFrame:
    """One row for each unit: its element's fields, ``run`` (the inlines' text), ``in_value``, ``lone`` and ``next_order``.

    ``lone``: the unit's element gives no text to the body. ``next_order`` is
    the order of the element after the run. A unit without an element has
    ``element_type`` null. ``more``: other columns of the element to keep. Two
    shuffles by document, for the ancestors and for the units.
    """
    # a null kind hides itself and isn't asked of as an ancestor
    root = F.coalesce(~F.col("kind").isin("block", "inline") | ((F.col("kind") == "block") & (F.col("element_type") == "metadata")), F.lit(False))
    related = Related(rows, doc_cols, {"hidden": root})
    hidden = _hides() | related.above("hidden")
    return _grouped(heading_scope(related.df, doc_cols), doc_cols, hidden, more or [])


#: A JSON string; the possessive loop takes the matcher no deeper for long ones.
_STRING = r'(?s)"(?:[^"\\]|\\.)*+"'
#: Stands for a string where only the rest is looked at; JSON has no such character.
_HOLD = "\x01"


def _cells(content: Column) -> Column:
    """The non-empty strings among a JSON text's values, in order; a text that isn't JSON is its own only cell.

    Strings are found by their quotes; one with a colon behind it is a key. The
    text is JSON if each string is, and if it is a single value with an empty
    text for each string and with keys numbered, so that a key may stand twice.
    Nesting is followed as deep as the engine's parser goes, 1,000 levels.
    """
    tokens = F.regexp_extract_all(content, F.lit(_STRING + r"(?:[ \t\n\r]*+:)?"), F.lit(0))
    parsed = lambda token: F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
    values = F.transform(F.filter(tokens, lambda t: t.endswith('"')), parsed)
    sound = F.forall(tokens, lambda t: F.try_parse_json(F.regexp_replace(t, "[ \\t\\n\\r]*+:$", "")).isNotNull())
    rest = F.split(F.regexp_replace(content, _STRING, _HOLD), _HOLD + r"[ \t\n\r]*+:")
    numbered = F.transform(rest, lambda part, i: F.concat(F.when(i > 0, F.concat(F.lit('"'), i.cast("string"), F.lit('":'))).otherwise(""), F.replace(part, F.lit(_HOLD), F.lit('""'))))
    bare = F.array_join(numbered, "")
    # inside a list and inside an object: so it is one value, and nothing behind it
    single = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"0":'), bare, F.lit("}"))).isNotNull()
    found = F.when(~content.contains(_HOLD) & single & sound, F.filter(values, lambda v: v != "")).otherwise(F.array(content))
    return F.when(content.isNotNull(), found)


def unit_text(separator: str) -> Column:
    """A unit's text: content, else run; of a table in JSON, its cells; nothing for rules and raw blocks."""
    table = ~F.col("lone") & (F.col("element_type") == "table") & (F.col("encoding") == "json")
    content = F.coalesce(F.col("content"), F.lit(""))
    plain = F.when(F.col("lone") | (content == ""), F.col("run")).otherwise(content)
    cells = F.array_join(_cells(F.when(table, plain)), separator)
    skipped = ~F.col("lone") & F.col("element_type").isin("hr", "raw")
    return F.when(skipped, "").when(table, cells).otherwise(plain)


def texts(rows: DataFrame, doc_cols: list[str], separators: dict[str, str]) -> DataFrame:
    """One row for each document, with its body's text once for each name and separator."""
    said = units(rows, doc_cols).withColumns({f"__{out}": unit_text(separator) for out, separator in separators.items()})

    def joined(out: str, separator: str) -> Column:
        pieces = F.collect_list(F.when(F.col(f"__{out}") != "", F.struct("pos", F.col(f"__{out}").alias("t"))))
        return F.array_join(F.transform(F.array_sort(pieces, lambda a, b: a["pos"] - b["pos"]), lambda x: x["t"]), separator).alias(out)

    return said.groupBy(*doc_cols).agg(*[joined(*x) for x in separators.items()])


def to_text(rows: DataFrame, doc_cols: list[str], separator: str = "\n\n", out: str = "text") -> DataFrame:
    """One row for each document: its body's text, units joined by ``separator``. Values and metadata are no text."""
    return texts(rows, doc_cols, {out: separator})


def to_match_text(rows: DataFrame, doc_cols: list[str], out: str = "text") -> DataFrame:
    """Text for searching: units joined by a space, so phrases across them are found."""
    return to_text(rows, doc_cols, " ", out)


def headings(rows: DataFrame, doc_cols: list[str], more: list[str] | None = None) -> DataFrame:
    """One row for each heading: ``pos``, ``level`` (rank), ``title``, ``id`` (empty if none), ``element_order``, and the source's attributes.

    Headings inside values don't count. ``body_order`` is the order of what
    follows the title's inlines, null at the end; ``depth`` is the element's level;
    ``more``: other columns of the heading's row to keep.
    """
    # a heading shows its title's inlines whatever it lies in, so no ancestors are needed
    found = _grouped(heading_scope(rows, doc_cols), doc_cols, F.lit(False), more or []).where((F.col("element_type") == "heading") & ~F.col("in_value"))
    content = F.coalesce(F.col("content"), F.lit(""))
    return found.select(
        *doc_cols, "pos", rank_of(F.col("attributes"), F.col("level")).alias("level"), F.when(content == "", F.col("run")).otherwise(content).alias("title"),
        F.coalesce(F.try_element_at("attributes", F.lit("id")), F.lit("")).alias("id"), "element_order", "attributes", "encoding",
        F.coalesce("level", F.lit(1)).alias("depth"), F.col("next_order").alias("body_order"), *(more or []),
    )
