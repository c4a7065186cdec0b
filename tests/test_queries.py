"""Every query with SQL gives what DuckDB gives for it, over whole small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docustrata.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(show, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = rows(plans.queries()[name](spark, SF).toPandas()), rows(duck.sql(plans.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "review_state", "status", "review_reasons", "reconcile_reasons"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
