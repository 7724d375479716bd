"""Every registered query of the library's own operators against its SQL."""

from __future__ import annotations

import pathlib

import duckdb
import pytest

from folia.plans import oracle, oracle_built, queries, queries_built

QUERIES = queries.QUERIES | queries_built.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | oracle_built.ORACLE_SQL

SF = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def _plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    found = sorted(tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    wanted = sorted(tuple(_plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert found == wanted


def test_every_rule_fires(duck):
    """In the SQL's rows, which the queries equal; the few documents of the smallest tables don't break them all."""
    con = duckdb.connect()
    for f in pathlib.Path("/root/testdata/sf0.01").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rules = {"validate": {*(f"V{i}" for i in range(1, 10)), "L1", "L2", "L4", "L5", "L6"}, "quality": {"empty_section", "duplicate_heading", "link_without_text"}}
    for name, wanted in rules.items():
        assert {r[0] for r in con.execute(f"SELECT DISTINCT rule FROM ({ORACLE_SQL[f'{name}_irregular']})").fetchall()} == wanted
    assert con.execute(f"SELECT count(DISTINCT rule) FROM ({ORACLE_SQL['lint_irregular']})").fetchone() == (15,)
