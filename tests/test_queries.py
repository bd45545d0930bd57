"""Every registered query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.queries import QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def cells(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None or v != v else round(v, 7) if isinstance(v, float) else v  # noqa: E731, PLR0124
    return [columns[i] for i in order], sorted((tuple(show(r[i]) for i in order) for r in data), key=repr)


def compare(spark, db, name):
    """Runs one registered query; its rows equal its SQL's, if it has one."""
    df = entry.queries()[name](spark, str(DATA))
    got = cells(df.columns, [tuple(r) for r in df.collect()])
    if sql := entry.oracle_sql().get(name):
        result = db.execute(sql)
        assert got == cells([c[0] for c in result.description], result.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    compare(spark, db, name)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
