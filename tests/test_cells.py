"""Cells of JSON tables, found in the engine, against a walk over the parsed text."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from folia.operators import text
from folia.schema import to_rows

RND = random.Random(14)


def slow_cells(content):
    class Pairs(list):
        pass

    def walk(value):
        if isinstance(value, str):
            return [value] if value else []
        if isinstance(value, Pairs):
            return [x for _, v in value for x in walk(v)]
        return [x for v in value for x in walk(v)] if isinstance(value, list) else []

    def refuse(name):
        raise ValueError(name)

    if content is None:
        return None
    try:
        return walk(json.loads(content, object_pairs_hook=Pairs, parse_constant=refuse))
    except ValueError:
        return [content]


def _value(depth):
    kind = RND.randrange(7 if depth else 4)
    if kind < 2:
        return json.dumps("".join(RND.choice(["a", '"', "\\", ":", ",", "{", "é", "\n", "字", " "]) for _ in range(RND.randint(0, 4))), ensure_ascii=RND.random() < 0.5)
    if kind < 4:
        return RND.choice(["1", "-2.5e3", "true", "null"])
    space = RND.choice(["", " ", "\n"])
    if kind == 4:
        return "[" + f"{space},".join(_value(depth - 1) for _ in range(RND.randint(0, 4))) + space + "]"
    return "{" + ",".join(f'{space}"{RND.choice(["k", "k", "x:", ""])}"{space}:{_value(depth - 1)}' for _ in range(RND.randint(0, 4))) + "}"


def test_cells_equal_a_walk(spark):
    texts = [_value(4) for _ in range(400)]
    texts += [t[:i] + RND.choice(['"', ",", "x", "]", ":", "\\", "\x01", ""]) + t[i + RND.randint(0, 1) :] for t in texts for i in [RND.randint(0, len(t))]]
    texts += [None, "", " ", '""', '"a"', '"a" x', '["a"]["b"]', '"a","b"', '"a":1', '1,"b":"c"', '{"a":"x","a":"y"}', '["a"1]', '[1"a"]', '["a""b"]', "[\x01]", '["\x01"]', "[S]", '["tab\t"]', '["\\q"]', '{"\\q":"a"}', "NaN", '["a",]', "'a'"]
    texts += ['["' + "x" * 200_000 + '"]', '["' + '\\"' * 50_000 + '"]', "[" * 200 + '"deep"' + "]" * 200, '{"headers":["h"],"rows":[' + ",".join(f'["c{i}",""]' for i in range(20_000)) + "]}"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text._cells(F.col("t")).alias("c")).collect()
    for r in found:
        assert r["c"] == slow_cells(texts[r["i"]]), texts[r["i"]][:200]


def test_text_of_tables_stays_in_the_engine(spark):
    element = "struct<kind:string,element_type:string,content:string,level:int,encoding:string,attributes:map<string,string>,element_order:int>"
    docs = spark.createDataFrame([(1, [("block", "table", '{"headers":["a","b"],"rows":[["x",""],["y"]]}', 1, "json", {}, 0), ("block", "paragraph", "p", 1, "text", {}, 1), ("block", "table", "broken [", 1, "json", {}, 2)])], f"doc int, blocks array<{element}>")
    rows = to_rows(docs, ["doc"])
    found = text.to_text(rows, ["doc"], "|")
    assert found.first()["text"] == "a|b|x|y|p|broken ["
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "PythonUDF" not in plan
