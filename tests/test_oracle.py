"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows(data):
    return sorted(tuple(map(plain, r)) for r in data)


def kind(name):
    """What a type holds, widths of whole numbers and floats aside."""
    name = str(name).upper()
    for what, names in {"int": ("BIGINT", "INT", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT"), "float": ("DOUBLE", "FLOAT")}.items():
        if name.startswith(names):
            return what
    return {"STRING": "VARCHAR"}.get(name, name.partition("(")[0])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()])
    found = duck.execute(SQL[name])
    assert df.columns == [c[0] for c in found.description]
    assert [kind(f.dataType.simpleString()) for f in df.schema.fields] == [kind(c[1]) for c in found.description]
    assert got == rows(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
