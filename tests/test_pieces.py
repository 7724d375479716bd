"""Ancestors by pieces of documents, against the pass over whole documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folia.operators import tree

RND = random.Random(2)
SCHEMA = "doc string, pos long, kind string, level int, content string"
def asked():
    return {"odd": F.col("content") == "odd", "deep": F.col("level") > 4}



def _rows(doc, n, levels):
    return [(doc, i, RND.choice(["block", "value", "inline", None]), RND.choice(levels), RND.choice(["odd", "even", None])) for i in range(n)]


ROWS = [r for i in range(12) for r in _rows(f"d{i}", RND.randint(1, 60), [1, 2, 3, 4, 5, 9, None])]
ROWS += _rows(None, 40, [1, 2, 3]) + [("down", i, "block", i + 1, "odd") for i in range(30)] + [("up", i, "value", 30 - i, "odd") for i in range(30)] + [("flat", i, "value", 3, None) for i in range(20)]


@pytest.mark.parametrize("piece_rows", [1, 2, 7, 1000])
def test_pieces_equal_whole_documents(spark, piece_rows):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    whole, pieces = (tree.Related(rows, ["doc"], asked(), n).df for n in (None, piece_rows))
    assert pieces.columns == whole.columns
    assert sorted(map(repr, pieces.collect())) == sorted(map(repr, whole.collect()))


def test_one_large_document(spark):
    """300,000 rows in 64 pieces: no group of rows is larger than a piece."""
    n, piece_rows = 300_000, 4_688
    rows = spark.range(n).select(
        F.lit("d").alias("doc"), F.col("id").alias("pos"), F.when(F.col("id") % 1009 == 5, "value").otherwise("block").alias("kind"), (1 + F.pmod(F.xxhash64("id"), F.lit(12))).cast("int").alias("level"), F.when(F.col("id") % 3 == 0, "odd").alias("content")
    )
    pieces = tree.Related(rows, ["doc"], asked(), piece_rows).df.orderBy("pos").toPandas()
    r = rows.orderBy("pos").toPandas()
    masks = [int(c == "odd") + 2 * int(level > 4) for c, level in zip(r["content"], r["level"], strict=True)]
    wanted = tree._relate([i == 0 for i in range(n)], r["level"].tolist(), masks, (r["kind"] == "value").tolist())
    for name, column in zip(["__above", "__parent", "__next", "__next_level", "__scope"], wanted, strict=True):
        got = [None if x != x else x for x in pieces[name].tolist()]
        assert got == column, name


def test_pieces_of_no_rows(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert tree.Related(rows, ["doc"], asked(), 5).df.count() == 0


def test_body_in_pieces(spark):
    rows = spark.createDataFrame([("a", i, k, None, lv, "text", {}, i) for i, (k, lv) in enumerate([("block", 1), ("value", 1), ("block", 2), ("block", 1), ("value", 2), ("inline", 3), ("block", 1)])], "doc string, pos long, kind string, content string, level int, encoding string, attributes map<string,string>, element_order int").withColumn("element_type", F.lit("div"))
    for piece_rows in (None, 1, 2, 3):
        assert sorted(r["pos"] for r in tree.body(rows, ["doc"], piece_rows).collect()) == [0, 3, 6]
