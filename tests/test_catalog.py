"""Every linear-algebra query against its SQL in DuckDB, at the smallest scale.

Queries that return entries are unioned a few at a time, so their small jobs run side by side.
"""

import glob
import os
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica import catalog

ENTRIES = ("trmm", "trsm", "pamm", "parfb", "pemv", "gemm_n", "gemm_t", "larf", "larft", "larfb", "syrk", "syr2k", "lauum", "trapezoid", "gemm_add", "gemm_sub")
SIDE_BY_SIDE = [n for n in catalog.QUERIES if n.startswith(ENTRIES) and n != "larfg"]
GROUPS = [SIDE_BY_SIDE[k : k + 8] for k in range(0, len(SIDE_BY_SIDE), 8)]


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return c


def expected(sql, name, columns):
    return sorted(sql.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SIDE_BY_SIDE])
def test_query(spark, data, sql, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert expected(sql, name, columns) == got and got


@pytest.mark.parametrize("names", GROUPS, ids=lambda n: n[0])
def test_entries(spark, data, sql, names):
    parts = [catalog.QUERIES[n](spark, data).select("i", "j", "v", F.lit(n).alias("name")) for n in names]
    rows = reduce(lambda a, b: a.unionByName(b), parts).collect()
    for n in names:
        got = sorted(((r["i"], r["j"], r["v"]) for r in rows if r["name"] == n), key=str)
        assert expected(sql, n, ["i", "j", "v"]) == got and got, n
