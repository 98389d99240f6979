"""Every registered query against its SQL in DuckDB."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert table(df.columns, rows) == table([c[0] for c in want.description], want.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    root = os.path.dirname(entry.__file__)
    for p in glob.glob(f"{root}/lodestrata/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "llm" not in open(p, encoding="utf-8").read(), p
