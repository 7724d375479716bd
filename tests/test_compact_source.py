"""The compact format as a data source: round trips, splits, refusals and what a failed job leaves."""

from __future__ import annotations

import json
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from folia.sources import compact, compact_source

RND = random.Random(6)
HARD = ["", None, "tab\tnew\nline \"q\" \\ ", "é字🙂 \x1f", "x" * 300]
SCHEMA = "doc string, pos long, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int"


def _rows(doc, n):
    types = [("block", "heading"), ("inline", "text"), ("value", "list"), ("block", "made:up"), ("odd", "thing")]
    keys = ["id", "heading_level", "other", "a"]
    return [(doc, i, *RND.choice(types), RND.choice(HARD), RND.randint(0, 5), RND.choice(["text", "json", "yaml"]), {k: RND.choice(["", "v", "é"]) for k in RND.sample(keys, RND.randint(0, 3))}, 3 * i) for i in range(n)]


def _key(rows):
    return sorted(repr((r["kind"], r["element_type"], r["content"], r["level"], r["encoding"], sorted(r["attributes"].items()))) for r in rows)


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([r for d in range(9) for r in _rows(f"d{d}", RND.randint(1, 300))], SCHEMA)


@pytest.mark.parametrize("split_bytes", [300, 4_096, 1 << 23])
def test_round_trip(spark, data, tmp_path, split_bytes):
    path = f"{tmp_path}/files"
    compact_source.save(data.repartition(5), path, ["doc"], split_bytes=split_bytes)
    found = compact_source.load(spark, path)
    assert found.columns == [c.split()[0] for c in compact_source.SCHEMA.split(", ")]
    rows = found.collect()
    assert _key(rows) == _key(data.collect())
    by_file = {}
    for r in rows:
        assert r["pos"] == r["element_order"]
        by_file.setdefault(r["filename"], []).append(r["pos"])
    assert all(sorted(v) == list(range(len(v))) for v in by_file.values())
    if split_bytes == 300:
        assert found.rdd.getNumPartitions() > len(by_file)
    # the engine's own reader and the numbers of both agree
    own = {(os.path.basename(r["filename"]), r["pos"], r["content"]) for r in compact.read_compact(spark, path).collect()}
    assert own == {(os.path.basename(r["filename"]), r["pos"], r["content"]) for r in rows}


def test_files_of_others(spark, tmp_path):
    lines = ['{"@":"4.2.0"}', "", '{"t":"P","c":"1","l":1}\r', " ", '{"@":"4.2.0"}', '{"t":"block:own","l":2,"e":"j","a":{"i":"x"},"m":{"z":"1","id":"lost"}}'] + [json.dumps({"t": "t", "c": str(i), "l": 1}) for i in range(2, 2_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("")
    (tmp_path / "_hidden").write_text("not JSON")
    for split_bytes in (100, 1_000, 1 << 20):
        rows = sorted(compact_source.load(spark, str(tmp_path), split_bytes).collect(), key=lambda r: r["pos"])
        assert [r["pos"] for r in rows] == list(range(len(rows))) and len(rows) == 2_000
        assert [r["content"] for r in rows if r["content"]] == ["1", *map(str, range(2, 2_000))]
        assert (rows[1]["kind"], rows[1]["element_type"], rows[1]["encoding"], rows[1]["attributes"]) == ("block", "own", "json", {"id": "x", "z": "1"})
    one = compact_source.load(spark, f"file://{tmp_path}/a.jsonl", 1_000, "content string, pos int")
    assert one.columns == ["content", "pos"] and one.count() == 2_000


@pytest.mark.parametrize(("line", "message"), [('{"t":"ZZ","l":1}', "unknown type code"), ('{"l":1}', "unknown type code"), ('{"t":"P"}', "missing level"), ('{"t":"P","l":1,"a":{"??":"x"}}', "unknown attribute code")])
def test_lines_that_are_refused(spark, tmp_path, line, message):
    (tmp_path / "a.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match=message):
        compact_source.load(spark, str(tmp_path)).collect()


def test_a_changed_file_is_refused(spark, data, tmp_path):
    path = tmp_path / "files"
    compact_source.save(data.coalesce(1), str(path), ["doc"], split_bytes=500)
    (name,) = [f for f in os.listdir(path) if f.startswith("part") and os.path.getsize(path / f) > 5_000][:1]
    text = (path / name).read_text()
    (path / name).write_text(text + '{"t":"P","l":1}\n')
    with pytest.raises(Exception, match="has changed"):
        compact_source.load(spark, str(path)).collect()
    lines = [x + "\n" for x in text.split("\n")[:-1]]
    at = next(i for i, x in enumerate(lines) if '"@"' not in x)
    lines[at] = " " * (len(lines[at].encode()) - 1) + "\n"  # as many bytes, one element fewer
    (path / name).write_text("".join(lines))
    with pytest.raises(Exception, match="has changed"):
        compact_source.load(spark, str(path)).collect()


def test_rows_in_the_wrong_order_are_refused_and_leave_nothing(spark, data, tmp_path):
    compact_source.register(spark)
    path = f"{tmp_path}/files"
    mixed = data.where("doc = 'd1'").coalesce(1).sortWithinPartitions(F.desc("pos"))
    with pytest.raises(Exception, match="must come in their order"):
        mixed.write.format("folia_compact").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    null = data.withColumn("level", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="null level"):
        compact_source.save(null, path, ["doc"])
    with pytest.raises(Exception, match="no columns"):
        data.drop("level").write.format("folia_compact").mode("append").save(path)
    with pytest.raises(FileNotFoundError):
        compact_source.load(spark, f"{tmp_path}/none")


def test_small_splits_are_read_together(spark, tmp_path):
    """Tasks, and what each is sent, don't grow with the number of splits asked for."""
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"t": "P", "c": str(i), "l": 1}) + "\n" for i in range(3_000)))
    found = compact_source.load(spark, str(tmp_path), 10)
    assert 100 < found.rdd.getNumPartitions() <= compact_source.TASKS + 1
    assert sorted((r["pos"], r["content"]) for r in found.collect()) == [(i, str(i)) for i in range(3_000)]
    marks = compact_source.counted(spark, str(tmp_path), 10)
    source = compact_source.CompactSource({"path": str(tmp_path), "splitbytes": "10", "marks": json.dumps(marks)})
    reader = source.reader(source.schema())
    assert len(reader.partitions()) > 100
    assert len(pickle.dumps((reader, source.options))) < 1_000


def test_close_marks_are_thinned(spark, data, tmp_path):
    path = f"{tmp_path}/files"
    compact_source.save(data.coalesce(1).withColumn("doc", F.lit("one")).withColumn("pos", F.monotonically_increasing_id()).withColumn("element_order", F.lit(0)), path, ["doc"], split_bytes=1)
    with open(f"{path}/{compact_source.INDEX}") as f:
        (kept,) = json.load(f)["files"].values()
    assert kept["lines"] == data.count() > compact_source.MARKS >= len(kept["marks"]) > compact_source.MARKS // 4
    (name,) = [f for f in os.listdir(path) if f.startswith("part")]
    text = open(f"{path}/{name}", "rb").read()
    for at, n in kept["marks"]:
        assert sum(b'"@":' not in x for x in text[:at].splitlines()) == n and (not at or text[at - 1 : at] == b"\n")
    rows = compact_source.load(spark, path, 1).collect()
    assert _key(rows) == _key(data.collect()) and sorted(r["pos"] for r in rows) == list(range(len(rows)))


def test_append_and_overwrite(spark, data, tmp_path):
    path = f"{tmp_path}/files"
    one = data.where("doc = 'd1'")
    for times in (1, 2):
        compact_source.save(one, path, ["doc"])
        assert compact_source.load(spark, path).count() == times * one.count()
    compact_source.save(one, path, ["doc"], "overwrite")
    assert compact_source.load(spark, path).count() == one.count()
    assert not [f for f in os.listdir(path) if f.startswith("_temporary")]
    compact_source.save(one.where("false"), path, ["doc"], "overwrite")
    assert compact_source.load(spark, path).count() == 0


def test_by_sql(spark, data, tmp_path):
    compact_source.save(data, f"{tmp_path}/files", ["doc"])
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW compact_files USING folia_compact OPTIONS (path '{tmp_path}/files')")
    assert spark.sql("SELECT count(*) FROM compact_files WHERE element_type = 'heading'").first()[0] == data.where("element_type = 'heading'").count()
