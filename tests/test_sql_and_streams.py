"""SQL names and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.functions import lists as L
from folia.plans.sql import register
from folia.streaming.documents import compact_stream, counts_by_type, once, transformed, write_table


def test_functions_in_sql(spark):
    names = register(spark)
    assert len(names) > 40
    row = spark.sql("""
        SELECT elements_document(array(build_h1('T'), build_paragraph('p'), build_link('u', null), build_hr())) AS d,
               elements_merge(build_text('a'), build_bold('b')) AS m, elements_filter(build_h2('x'), array('heading')) AS f,
               element_implicit_parent('caption', 'block') AS p, element_attr(build_link('u', 'x')[0], 'href') AS a
    """).first()  # fmt: skip
    assert [e["element_order"] for e in row["d"]] == [0, 1, 2, 3]
    assert [e["element_order"] for e in row["m"]] == [0, 1]
    assert (len(row["f"]), row["p"], row["a"]) == (1, "figure", "u")


def test_stream_of_documents(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.jsonl").write_text('{"@":"4.2.0"}\n{"t":"H","c":"T","l":1,"a":{"h":"1"}}\n{"t":"P","c":"p","l":1}\n')
    stream = transformed(once(compact_stream(spark, str(source)), "filename", "modified"), lambda b: L.keep_types(b, ["heading"]))
    assert stream.isStreaming
    write_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 3
    assert found.where(F.size("blocks") != 1).count() == 0
    counts = counts_by_type(compact_stream(spark, str(source)), "modified")
    query = counts.writeStream.format("memory").queryName("type_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["element_type"], r["n"]) for r in spark.table("type_counts").groupBy("element_type").agg(F.sum("n").alias("n")).collect()} == {("heading", 3), ("paragraph", 3)}
