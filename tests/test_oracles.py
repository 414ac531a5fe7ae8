"""Every query with SQL gives the rows that DuckDB gives; the others give rows with their schema."""

import os

import duckdb
import pytest
from factloom.plans import document_queries, queries


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        return x.isoformat() if hasattr(x, "isoformat") else repr(float(x)) if hasattr(x, "quantize") else repr(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


ALL = {**queries.QUERIES, **document_queries.QUERIES}
SQL = {**queries.SQL, **document_queries.SQL}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf, duck, name):
    df = ALL[name](spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows_of(want.fetchall(), want.columns)
    else:
        assert got
