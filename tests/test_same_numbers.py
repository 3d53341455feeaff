"""Images whose inspections have the same number, a digest of six digits, against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.plans import creation_queries, ledger_queries
from tests.test_oracles import plain

SF = "/root/testdata/sf0.1"
PAIRS = [(4163, 8864), (6792, 10092), (8082, 11674), (3501, 12012), (2955, 12596), (4800, 14480), (8861, 15294)]
KNOWN = creation_queries.QUERIES | ledger_queries.QUERIES, creation_queries.ORACLES | ledger_queries.ORACLES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("same")
    spark.read.parquet(f"{SF}/part.parquet").where(F.col("p_partkey").isin([i for pair in PAIRS for i in pair])).write.parquet(f"{folder}/part.parquet")
    for name in ("customer", "supplier", "nation", "region"):
        os.symlink(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["q_created_violations", "q_penalty_notices", "q_registered"])
def test_inspections_of_the_same_number_are_kept_apart(spark, tables, name):
    con = duckdb.connect()
    for t in ("part", "customer", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet{'/*.parquet' if t == 'part' else ''}'")
    cursor = con.execute(KNOWN[1][name])
    columns = [c[0] for c in cursor.description]
    expected = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in KNOWN[0][name](spark, tables).collect()), key=str) == expected
    assert expected
