"""Registered queries for builders in all their forms, SQL names, files, blocks of sections and pages, profiles and narrow rendering."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia import vocabulary as V
from folia.functions import ansi
from folia.functions import builders as B
from folia.functions import elements as E
from folia.functions import lists as L
from folia.operators import outline, retrieve, text
from folia.plans import sql, table_functions
from folia.plans.queries import DOC, flat, flat_attributes
from folia.schema import FIELDS, from_text, to_list, to_rows
from folia.scratch import scratch_root
from folia.sources import compact, compact_source
from folia.sources.conversations import conversation_rows, irregular_rows, nested_rows
from folia.sources.parquet import read_elements, version_of, write_elements
from folia.sources.profile import merged, profile, profile_file, profile_state, told

TURN = ["conv_id", "turn"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _built(spark: SparkSession, sf_dir: str, parts: list) -> DataFrame:
    """A document of the parts for each turn."""
    made = L.assemble(F.concat(*parts))
    return flat(to_rows(_turns(spark, sf_dir).select(*TURN, made.alias("blocks")), TURN), TURN)


def block_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, said = F.col("role"), F.col("text")
    parts = [
        B.plain(said), B.code(said, role), B.blockquote(role), B.blockquote(role, level=2), B.list_item(role, True), B.metadata(role), B.image(role, "alt"), B.raw(role, "tex"),
        B.div(children=B.paragraph(role), id="i"), B.section(2, "T", children=F.concat(B.paragraph(role), B.hr())), B.section(None, inlines=[B.text(role)]), B.section(3, role),
    ]
    return _built(spark, sf_dir, parts)


def children_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    parts = [
        B.heading(1, children=B.text(role)), B.paragraph(texts=F.array(role, F.lit(None).cast("string"), F.lit("x"))), B.plain(children=B.text(role)), B.blockquote(children=B.paragraph(role)),
        B.list_of(parts=[B.list_item(role)]), B.bold(children=B.text(role)), B.strikethrough(role), B.superscript(role), B.subscript(role), B.link("u", parts=[B.text(role)]), B.quoted(parts=[B.text(role)]),
        B.span(children=B.text(role)), B.heading(None, parts=[B.text(role), B.italic(parts=[B.text("y")])]),
    ]
    return _built(spark, sf_dir, parts)


def sql_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The builders by their SQL names."""
    sql.register(spark)
    made = """elements_assemble(concat(build_h1(role), build_paragraph(text), build_ul(array(role, null)), build_ol(array(role)), build_div(build_paragraph(role), 'i', null), build_metadata(role),
      build_section(2, role, build_hr()), build_math(role), build_quoted(role), build_cite(role), build_span(role, 'i', 'c'), build_bold(role), build_link('u', role), build_pre('sql', text)))"""
    return flat(to_rows(_turns(spark, sf_dir).select(*TURN, F.expr(f"elements_rebase_levels(elements_reorder(elements_stamp({made})), 1)").alias("blocks")), TURN), TURN)


def sql_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The builders' short names in SQL."""
    sql.register(spark)
    made = ", ".join([f"build_{name}({'text' if name == 'p' else 'role'})" for name in sql.ALIASES])
    return flat(to_rows(_turns(spark, sf_dir).select(*TURN, F.expr(f"elements_assemble(concat({made}))").alias("blocks")), TURN), TURN)


def element_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements made from fields, structs and texts, and what the vocabulary says of them."""
    rows = irregular_rows(spark, sf_dir)
    whole = E.block(F.col("element_type"), F.col("content"), F.col("level"), F.col("encoding"), F.col("attributes"), F.col("element_order"))
    pair = F.struct(F.col("element_type").alias("a"), F.col("content").alias("b"))
    made = rows.withColumns({"w": whole, "p": pair})
    short, inline = E.to_element(F.col("p"), made.schema["p"].dataType), from_text(F.col("content"))
    return made.select(
        *DOC, "pos", F.col("w.kind").alias("kind"), F.col("w.level").alias("level"), F.col("w.encoding").alias("encoding"), F.col("w.element_order").alias("ord"), flat_attributes(F.col("w.attributes")).alias("attributes"),
        short["kind"].alias("short_kind"), short["element_type"].alias("short_type"), short["level"].alias("short_level"), inline["element_type"].alias("inline_type"), E.is_valid(F.struct(*FIELDS)).alias("valid"),
        V.implicit_parent(F.col("element_type"), F.col("kind")).alias("parent"), V.is_body(F.col("kind"), F.col("element_type")).alias("body"),
        F.size(V.kind_names()).alias("kinds"), F.size(V.type_names()).alias("types"), F.size(V.encoding_names()).alias("encodings"), V.spec_version().alias("version"),
    )


def compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as files of lines and read again; ``numbered``: each file's orders run from 0 without gaps."""
    path = f"{scratch_root(spark)}/folia/compact-{uuid.uuid4().hex}"
    compact.write_compact(to_list(nested_rows(spark, sf_dir), DOC), path)
    rows = compact.read_compact(spark, path)
    whole = Window.partitionBy("filename")
    numbered = F.max("pos").over(whole) + 1 == F.count(F.lit(1)).over(whole)
    return rows.withColumn("numbered", numbered).select("kind", "element_type", "content", "level", "encoding", flat_attributes().alias("attributes"), "numbered")


def compact_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the data source, in splits of 4 kB."""
    path = f"{scratch_root(spark)}/folia/compact-{uuid.uuid4().hex}"
    compact_source.save(nested_rows(spark, sf_dir), path, DOC, split_bytes=4_096)
    rows = compact_source.load(spark, path)
    whole = Window.partitionBy("filename")
    numbered = F.max("pos").over(whole) + 1 == F.count(F.lit(1)).over(whole)
    return rows.withColumn("numbered", numbered).select("kind", "element_type", "content", "level", "encoding", flat_attributes().alias("attributes"), "numbered")


def compact_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by type, of files that another writer left; lines are counted first and only one column is read."""
    path = f"{scratch_root(spark)}/folia/compact-{uuid.uuid4().hex}"
    compact.write_compact(to_list(nested_rows(spark, sf_dir), DOC), path)
    rows = compact_source.load(spark, path, split_bytes=4_096, schema="element_type string, pos int")
    return rows.groupBy("element_type").agg(F.count(F.lit(1)).alias("n"))


def _opened(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(*DOC, *columns, F.posexplode_outer("blocks").alias("i", "b")).select(*DOC, *columns, "i", F.col("b.element_type").alias("element_type"), F.col("b.content").alias("content"))


def sections_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(retrieve.sections_with_content(conversation_rows(spark, sf_dir), DOC, blocks=True), "section_id", "start_order")


def sections_like_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(retrieve.sections_like(conversation_rows(spark, sf_dir), DOC, "the_", blocks=True), "section", "start_order")


def pages_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with given numbers."""
    rows = nested_rows(spark, sf_dir)
    given = F.when(F.col("element_type") == "page_break", F.create_map(F.lit("page_number"), (F.col("pos") + 100).cast("string"))).otherwise(F.col("attributes"))
    return _opened(retrieve.page_rows(rows.withColumn("attributes", given), DOC, blocks=True), "page_number", "start_order", "end_order", "block_count")


def sections_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose titles are the roles, so that ids repeat."""
    rows = conversation_rows(spark, sf_dir)
    title = F.when(F.col("element_type") == "heading", F.substring_index("content", " ", 1)).otherwise(F.col("content"))
    return outline.sections(rows.withColumn("content", title), DOC).select(*DOC, "section_id", "title", "start_order")


def to_text_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.to_text(irregular_rows(spark, sf_dir), DOC)


def link_structs_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = to_list(irregular_rows(spark, sf_dir), DOC)
    return docs.select(*DOC, F.explode(L.link_structs(F.col("blocks"))).alias("x")).select(*DOC, "x.*")


def _by_sql(rows: DataFrame, call: str) -> DataFrame:
    """A table function over some rows, called in SQL."""
    spark = rows.sparkSession
    table_functions.register(spark)
    view = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {call.replace('{rows}', f'TABLE({view})')}")


def sql_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sql(conversation_rows(spark, sf_dir), "document_sections({rows}, 'conv_id')")


def sql_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _by_sql(conversation_rows(spark, sf_dir), "document_section({rows}, 'conv_id', 'user 0')")
    return flat(found)


def sql_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sql(irregular_rows(spark, sf_dir), "document_violations({rows}, 'conv_id')").select("conv_id", "element_order", "rule", "field")


def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is exact of a table's profile."""
    found = profile(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return found.select("column_name", "min", "max", F.round("avg", 3).alias("avg"), F.round("std", 3).alias("std"), "count", "null_percentage")


def profile_file_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the file."""
    found = profile_file(spark, f"{sf_dir}/orders.parquet").where(F.col("column_name").isin("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return found.select("column_name", "min", "max", F.round("avg", 3).alias("avg"), F.round("std", 3).alias("std"), "count", "null_percentage")


def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of three parts of a table, merged; ``near``: the median's rank is within a hundredth of a half, the distinct values within a twentieth."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    states = reduce(DataFrame.unionByName, [profile_state(orders.where(F.pmod("o_orderkey", F.lit(3)) == i)) for i in range(3)])
    found = told(merged(states)).alias("p")
    values = orders.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in orders.columns])))
    seen = values.join(F.broadcast(found.select(F.col("column_name").alias("name"), F.col("q50"))), "name").groupBy("name").agg(
        F.count_distinct("v").alias("distinct"), F.avg((F.col("v").try_cast("double") <= F.col("q50").cast("double")).cast("int")).alias("at"), F.avg((F.col("v").try_cast("double") < F.col("q50").cast("double")).cast("int")).alias("below")
    )
    near = (F.abs(F.col("approx_unique") - F.col("distinct")) <= F.col("distinct") * 0.05) & (F.col("q50").isNull() | ((F.col("below") <= 0.51) & (F.col("at") >= 0.49)))
    out = found.join(seen, F.col("column_name") == F.col("name"))
    return out.select("column_name", "min", "max", F.round("avg", 3).alias("avg"), F.round("std", 3).alias("std"), "count", "null_percentage", near.alias("near"))


def parquet_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to Parquet and read again, with the version that the footer tells."""
    path = f"{scratch_root(spark)}/folia/elements-{uuid.uuid4().hex}"
    write_elements(nested_rows(spark, sf_dir), path, DOC)
    rows = read_elements(spark, path)
    return flat(rows).withColumn("version", F.lit(version_of(rows)))


#: Eight words of nine characters, a rule wider than the page, a table and a list.
_WORDS = "abcdefghi " * 8
_TABLE = '{"headers":["a","b"],"rows":[["x","yy"],["z",""]]}'


def render_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns drawn in 40 columns in both themes, with lines that wrap."""
    role = F.col("role")
    table = F.array(E.block("table", _TABLE, encoding="json"))
    made = L.assemble(F.concat(B.heading(1, role), B.paragraph(F.lit(_WORDS)), B.blockquote(F.lit(_WORDS)), B.list_of(F.array(role, F.lit(_WORDS))), B.hr(), table))
    docs = _turns(spark, sf_dir).select(*TURN, made.alias("blocks"))
    return docs.select(*TURN, ansi.render(F.col("blocks"), 40, "light").alias("light"), ansi.render(F.col("blocks"), 40, "dark").alias("dark"))


def compact_refused_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why elements have no line: of every few, one lacks something."""
    rows = conversation_rows(spark, sf_dir)
    every = lambda n, c, x: F.when(F.col("pos") % n == 1, F.lit(x)).otherwise(F.col(c))
    attributes = F.when(F.col("pos") % 13 == 1, None).when(F.col("pos") % 11 == 1, F.create_map(F.lit("k"), F.lit(None).cast("string"))).otherwise(F.col("attributes"))
    broken = rows.withColumns({"level": every(5, "level", None), "encoding": F.when(F.col("pos") % 7 == 1, None).when(F.col("pos") % 6 == 1, "j").otherwise(F.col("encoding")), "attributes": attributes})
    return broken.select(*DOC, "pos", compact.refusal(F.struct(*FIELDS)).alias("refusal"))


def compact_refused_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lines are none of the format's: their type, attributes or level made from places and roles."""
    turns = _turns(spark, sf_dir)
    n = F.col("conv_id") * 7 + F.col("turn")
    parts = [
        F.when(n % 5 == 0, F.concat(F.lit('"t":"'), F.col("role"), F.lit('"'))).when(n % 5 == 1, '"t":"own:kind"').when(n % 5 == 2, None).otherwise('"t":"P"'),
        F.when(n % 3 == 0, '"a":{"i":"x","zz":"y"}').when(n % 3 == 1, '"a":{"i":"x"}'), F.when(n % 4 != 0, '"l":1'),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return turns.select(*TURN, compact.refused(F.from_json(text, compact.LINE)).alias("refusal"))


def render_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small rendering functions: styles, padding, code, lists, single elements by their attributes, SQL literals."""
    role, said = F.col("role"), F.col("text")
    items = F.to_json(F.array(role, F.lit("b")))
    ordered = F.create_map(F.lit("ordered"), F.when(F.col("turn") % 2 == 0, "true").otherwise("false"))
    return _turns(spark, sf_dir).select(
        *TURN, ansi.ansi("1;31", role).alias("styled"), ansi.pad(role, 9).alias("padded"), ansi.code_lines(said, role).alias("code"), ansi.list_lines(items, F.lit("true")).alias("list"),
        ansi.render_one(F.lit("list"), items, ordered).alias("one_list"), ansi.render_one(F.lit("blockquote"), said, ordered).alias("one_quote"), ansi.render_one(F.lit("hr"), said, ordered).alias("one_rule"),
        ansi.render_one(F.lit("metadata"), said, ordered).alias("one_metadata"), ansi.literal(F.when(F.col("turn") > 0, said)).alias("literal"),
    )


def render_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in JSON as table elements, and drawn; the second object lacks a cell."""
    objects = F.concat(F.lit("["), F.to_json(F.struct(F.col("role").alias("who"), F.col("turn").cast("string").alias("n"))), F.lit(","), F.to_json(F.struct(F.col("role").alias("who"))), F.lit("]"))
    made = _turns(spark, sf_dir).withColumn("t", ansi.json_to_table(objects))
    return made.select(*TURN, F.col("t.element_type").alias("element_type"), F.col("t.encoding").alias("encoding"), F.col("t.content").alias("content"), ansi.table_lines(F.col("t.content")).alias("drawn"))


def render_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as a table element: turns by role."""
    counts = _turns(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n")).orderBy("role")
    return ansi.query_table(counts.coalesce(1).sortWithinPartitions("role")).select(F.col("blocks")[0]["content"].alias("content"))


def render_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of wide and joined characters, which take two columns each, wrapped to twelve columns: five of them and a space fit."""
    wide = F.lit("\u6f22\u5b57\u6f22\u5b57\u6f22 " * 3 + "e\u0301e\u0301 \U0001f468\u200d\U0001f469\u200d\U0001f467")
    docs = _turns(spark, sf_dir).select(*TURN, L.assemble(F.concat(B.paragraph(wide), B.paragraph(F.col("role")))).alias("blocks"))
    return docs.select(*TURN, ansi.render(F.col("blocks"), 12, "dark").alias("rendered"))


QUERIES = {
    "block_builders": block_builders,
    "children_builders": children_builders,
    "sql_builders": sql_builders,
    "sql_aliases": sql_aliases,
    "element_forms": element_forms,
    "compact_files": compact_files,
    "compact_source_rows": compact_source_rows,
    "compact_source_types": compact_source_types,
    "sections_blocks": sections_blocks,
    "sections_like_blocks": sections_like_blocks,
    "pages_blocks": pages_blocks,
    "sections_repeated": sections_repeated,
    "to_text_irregular": to_text_irregular,
    "link_structs_irregular": link_structs_irregular,
    "sql_sections": sql_sections,
    "sql_section": sql_section,
    "sql_violations": sql_violations,
    "profile_orders": profile_orders,
    "profile_file_orders": profile_file_orders,
    "profile_merged": profile_merged,
    "parquet_elements": parquet_elements,
    "compact_refused_elements": compact_refused_elements,
    "compact_refused_lines": compact_refused_lines,
    "render_parts": render_parts,
    "render_tables": render_tables,
    "render_result": render_result,
    "render_wide": render_wide,
    "render_narrow": render_narrow,
}
