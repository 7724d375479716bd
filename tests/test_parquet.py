"""Elements in Parquet: versions in footers, refusals, sizes."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folia.sources import parquet
from folia.vocabulary import SPEC_VERSION

SCHEMA = "doc long, pos int, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int, note string"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(d, i, "block", ["heading", "paragraph"][i % 2], f"text {i}", 1 + i % 3, "text", {"id": str(i)} if i % 4 == 0 else {}, i, "n") for d in range(30) for i in range(500)]
    return spark.createDataFrame(data, SCHEMA).repartition(7)


def _size(path):
    return sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))


def _column(path, name):
    meta = pq.read_metadata(next(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")))
    columns = [meta.row_group(i).column(j) for i in range(meta.num_row_groups) for j in range(meta.num_columns)]
    return sum(c.total_compressed_size for c in columns if c.path_in_schema == name)


def test_round_trip_and_footers(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    parquet.write_elements(rows, path, ["doc"], files=2)
    found = parquet.read_elements(spark, path)
    assert found.columns == rows.columns
    key = lambda df: sorted(repr(r) for r in df.select(rows.columns).collect())
    assert key(found) == key(rows) and parquet.version_of(found) == SPEC_VERSION
    versions = parquet.footer_versions(spark, path).collect()
    assert len(versions) == len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 2 and {r["version"] for r in versions} == {SPEC_VERSION}
    name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    table = pq.read_table(f"{path}/{name}")
    docs, places = table["doc"].to_pylist(), table["pos"].to_pylist()
    assert list(zip(docs, places, strict=True)) == sorted(zip(docs, places, strict=True))


def test_other_versions_are_refused(spark, rows, tmp_path):
    old, none = f"{tmp_path}/old", f"{tmp_path}/none"
    parquet.stamped(rows, "0.9").write.parquet(old)
    rows.write.parquet(none)
    with pytest.raises(ValueError, match="version 0.9"):
        parquet.read_elements(spark, old)
    with pytest.raises(ValueError, match="version None"):
        parquet.read_elements(spark, none)
    assert parquet.read_elements(spark, old, ("0.9", "1.4")).count() == rows.count()
    parquet.stamped(rows.limit(5), "1.4").write.mode("append").parquet(old)
    assert {r["version"] for r in parquet.footer_versions(spark, old).collect()} == {"0.9", "1.4"}


def test_order_and_pages_pay(rows, tmp_path):
    rows.write.option("compression", "zstd").parquet(f"{tmp_path}/plain")
    parquet.write_elements(rows, f"{tmp_path}/v1", ["doc"], v2=False, files=1)
    parquet.write_elements(rows, f"{tmp_path}/v2", ["doc"], files=1)
    assert _size(f"{tmp_path}/v1") < _size(f"{tmp_path}/plain")
    long = rows.where("doc < 1").sparkSession.range(15_000).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("pos"), F.lit("block").alias("kind"), F.lit("hr").alias("element_type"), F.lit("").alias("content"), F.lit(1).alias("level"), F.lit("text").alias("encoding"), F.create_map().cast("map<string,string>").alias("attributes"), F.col("id").cast("int").alias("element_order"))
    for name, v2 in (("l1", False), ("l2", True)):
        parquet.write_elements(long, f"{tmp_path}/{name}", ["doc"], v2=v2, files=1)
    assert _column(f"{tmp_path}/l2", "element_order") * 10 < _column(f"{tmp_path}/l1", "element_order")
    parquet.write_elements(rows, f"{tmp_path}/small", ["doc"], files=1, row_group_bytes=1 << 16)
    name = next(f for f in os.listdir(f"{tmp_path}/small") if f.endswith(".parquet"))
    assert pq.ParquetFile(f"{tmp_path}/small/{name}").num_row_groups > 1


def test_empty(spark, rows, tmp_path):
    parquet.write_elements(rows.where(F.lit(False)), f"{tmp_path}/e", ["doc"])
    assert parquet.read_elements(spark, f"{tmp_path}/e").count() == 0
