"""Every registered engine query against its SQL twin on the small tables."""

import glob
import os

import duckdb
import pytest

from docquarry.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def said(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    r = con.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(said(x) for x in row) for row in r.fetchall())
    assert sorted(tuple(said(row[c]) for c in names) for row in df.collect()) == want


def test_predicates_reach_the_scan(spark, sf):
    plan = QUERIES["filter_gte"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan and "l_comment" not in plan


def test_top_k_is_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in QUERIES["flagship"](spark, sf)._jdf.queryExecution().executedPlan().toString()
