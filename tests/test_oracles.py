"""Every query with SQL against DuckDB on the smallest tables: same columns, same rows."""

import math
import os

import duckdb
import pytest

from tessera.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or str(v) in ("<NA>", "NaT") or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_same_as_sql(spark, db, name):
    got, want = all_queries.QUERIES[name](spark, SF).toPandas(), db.sql(all_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLES)))
def test_runs(spark, name):
    assert all_queries.QUERIES[name](spark, SF).count() > 0
