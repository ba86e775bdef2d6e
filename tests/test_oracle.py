"""Every registered road-graph query against its SQL twin in DuckDB at sf0.001, or those in ORACLE_SF_DIR."""

import glob
import math
import os

import duckdb
import pytest

from wayloom.plans import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = rel.fetchall()
    assert rows(df.columns, got) == rows(rel.columns, [[float(v) if type(v).__name__ == "Decimal" else v for v in r] for r in want])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
