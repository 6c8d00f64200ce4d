"""Every query of the library against the SQL registered beside it, on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from factloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


#: How Spark names the types of DuckDB that queries return.
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_says_what_its_sql_says(spark, tables, name):
    got = QUERIES[name].run(spark, SF)
    want = tables.execute(QUERIES[name].sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in want.description}
    assert {c: t for c, t in got.dtypes} == kinds
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())
