"""Profiles whose states merge, against profiles of the whole."""

from __future__ import annotations

import datetime
import functools
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.sources.profile import merged, profile, profile_file, profile_state, told

RND = random.Random(31)


@pytest.fixture(scope="module")
def table(spark):
    data = [(i, RND.choice([None, RND.randint(-(10**15), 10**15)]), RND.gauss(0, 1e6) if i % 7 else None, RND.choice(["a", "b", None, "é"]), datetime.date(2020, 1, 1) + datetime.timedelta(days=RND.randint(0, 900)), [i % 3], None, i % 2 == 0) for i in range(6_000)]
    return spark.createDataFrame(data, "id int, big long, x double, s string, d date, l array<int>, nothing int, b boolean").withColumn("price", (F.col("x") / 100).cast("decimal(20,2)"))


def _rows(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_parts_merged_equal_the_whole(table, parts):
    states = functools.reduce(DataFrame.unionByName, [profile_state(table.where(F.col("id") % parts == i)) for i in range(parts)])
    found, wanted = _rows(told(merged(states))), _rows(profile(table))
    assert found.keys() == wanted.keys() == set(table.columns)
    values = {c: sorted(float(r[0]) for r in table.where(F.col(c).isNotNull()).select(c).collect()) for c in ("id", "big", "x", "price")}
    for name, w in wanted.items():
        f = found[name]
        for c in ("column_type", "min", "max", "count", "null_count", "null_percentage"):
            assert f[c] == w[c], (name, c)
        for c in ("avg", "std"):
            assert (f[c] is None) == (w[c] is None) and (f[c] is None or abs(f[c] - w[c]) <= 1e-6 * max(1, abs(w["std"] or 0))), (name, c)
        n = table.select(name).where(F.col(name).isNotNull()).distinct().count()
        assert abs(f["approx_unique"] - n) <= 0.05 * n
        for q in (25, 50, 75):
            assert (f[f"q{q}"] is not None) == (name in values)
            if name in values:
                own = values[name]
                assert abs(sum(v <= float(f[f"q{q}"]) for v in own) / len(own) - q / 100) <= 0.01, (name, q)


def test_merging_in_steps(table):
    a, b, c = (profile_state(table.where(F.col("id") % 3 == i)) for i in range(3))
    one = _rows(told(merged(merged(a.unionByName(b)).unionByName(c))))
    other = _rows(told(merged(a.unionByName(b).unionByName(c))))
    for name in one:
        for col in ("min", "max", "count", "null_count", "approx_unique"):
            assert one[name][col] == other[name][col]


def test_large_whole_numbers_keep_their_extremes(spark):
    state = lambda v: profile_state(spark.createDataFrame([(v,)], "n long"))
    r = told(merged(state(2**53 + 1).unionByName(state(2**53)))).first()
    assert (r["min"], r["max"], r["count"]) == (str(2**53), str(2**53 + 1), 2)


def test_states_of_nothing(spark, table, tmp_path):
    none = profile_state(table.where("false"))
    assert {r["count"] for r in told(merged(none)).collect()} == {0}
    assert {k: r["max"] for k, r in _rows(told(merged(none.unionByName(profile_state(table))))).items()} == {k: r["max"] for k, r in _rows(profile(table)).items()}
    # a state outlives its session as a table
    profile_state(table).write.parquet(f"{tmp_path}/day.parquet")
    assert told(merged(spark.read.parquet(f"{tmp_path}/day.parquet"))).count() == len(table.columns)
    table.select("id", "s").write.parquet(f"{tmp_path}/t.parquet")
    assert _rows(profile_file(spark, f"{tmp_path}/t.parquet"))["id"]["max"] == "5999"
