"""Every registered catalogue query against its SQL in DuckDB, on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from tessera.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted([text(r[c]) for c in names] for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = rows(QUERIES[name](spark, SF).toArrow())
    want = duck.sql(ORACLES[name]).arrow()
    assert got == rows(want.read_all() if hasattr(want, "read_all") else want)


def test_entry(spark):
    assert driver.entry(spark).columns == ["author_name", "author_catalog_slug", "eligible_item_count", "total_recommendation_count"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
