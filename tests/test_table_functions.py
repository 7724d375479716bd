"""Table functions called in SQL, against the operators of the same meaning, on documents that break every rule."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folia.operators import check, outline, retrieve
from folia.plans import table_functions

RND = random.Random(21)
SCHEMA = "doc string, part int, pos int, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int, extra string"


def _document(doc, part, n):
    pick, out = RND.choice, []
    for i in range(n):
        kind = pick(["block", "block", "inline", "value", None, "odd"])
        etype = pick({"inline": ["text", "space", "linebreak", "image", "heading"], "value": ["list", "string"]}.get(kind, ["heading", "heading", "paragraph", "list_item", "caption", "list", "figure", "document", "", None]))
        attributes = pick([None, {}, {"heading_level": pick(["1", "2", " 3x", "x", "99999999999", ""])}, {"id": "own", "alt": "A"}])
        out.append((doc, part, i, kind, etype, pick([None, "", "a", "A-1", "A", "b c", "É"]), pick([None, 0, 1, 1, 2, 3, 7]), pick(["text", "json", None, "odd", ""]), attributes, pick([i, i, i, i + 1, None, -1]), "x"))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    data = [r for d in range(40) for r in _document(None if d == 7 else f"d{d % 20}", d // 20, RND.randint(1, 40))]
    table = spark.createDataFrame(data, SCHEMA).repartition(3).cache()
    table.createOrReplaceTempView("elements")
    table_functions.register(spark)
    return table


def _same(found, wanted):
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    key = lambda df: sorted(repr(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in (r[c] for c in columns))) for r in df.collect())
    got, want = key(found), key(wanted)
    assert got == want and got


def test_sections(spark, rows):
    found = spark.sql("SELECT * FROM document_sections(TABLE(elements), 'doc, part')")
    _same(found, outline.sections(rows, ["doc", "part"]))
    # documents are dealt once
    assert found._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1


def test_violations(spark, rows):
    _same(spark.sql("SELECT * FROM document_violations(TABLE(elements), 'doc,part')"), check.validate(rows, ["doc", "part"]))


@pytest.mark.parametrize("pattern", ["a", "own", "%1", "_ c", "none of these", ""])
def test_section(spark, rows, pattern):
    found = spark.sql(f"SELECT * FROM document_section(TABLE(SELECT * FROM elements), 'doc,part', '{pattern}')")
    wanted = retrieve.get_section(rows, ["doc", "part"], pattern)
    if wanted.count():
        _same(found, wanted)
    else:
        assert found.count() == 0


def test_misuse(spark, rows):
    with pytest.raises(Exception, match="no columns nothing"):
        spark.sql("SELECT * FROM document_sections(TABLE(elements), 'nothing')").collect()
    with pytest.raises(Exception, match="second argument"):
        spark.sql("SELECT * FROM document_sections(TABLE(elements), 5)").collect()
    with pytest.raises(Exception, match="a table"):
        spark.sql("SELECT * FROM document_sections('elements', 'doc')").collect()
    spark.sql("SELECT * FROM elements WHERE false").createOrReplaceTempView("none")
    assert spark.sql("SELECT * FROM document_violations(TABLE(none), 'doc')").count() == 0
    assert spark.sql("SELECT count(DISTINCT v.rule) FROM document_violations(TABLE(elements), 'doc,part') v WHERE v.rule LIKE 'V%'").first()[0] == 9


def test_ranks_and_slugs_equal_the_engines(spark):
    from folia.functions.lists import rank_of

    values = ["1", " 3x", "x", "", None, "-2", "99999999999", "2147483648", "+4", "\n6"]
    table = spark.createDataFrame([(v, lv, t) for v in values for lv in (None, 5) for t in ["A b", "-É-x_", "", "ÀÉ", "a--B"]], "v string, l int, t string")
    attrs = F.map_filter(F.create_map(F.lit("heading_level"), F.col("v")), lambda _, x: x.isNotNull())
    for r in table.select("v", "l", "t", rank_of(attrs, F.col("l")).alias("rank"), outline.slug(F.col("t")).alias("slug")).collect():
        assert r["rank"] == table_functions.rank({"heading_level": r["v"]} if r["v"] is not None else {}, r["l"])
        assert r["slug"] == table_functions.slug(r["t"])
