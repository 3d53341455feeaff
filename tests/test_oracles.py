"""Every query with an oracle, against DuckDB over the same tables."""

import os

import duckdb
import pytest

from shelfmark.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=str)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
    assert a[:3] == b[:3] and len(a) == len(b)
    assert a == b
