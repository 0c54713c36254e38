"""The driver contract: every query runs; those with SQL agree with it; nothing is compared while empty."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievemill.plans import queries as plans

#: The smallest tables leave some results empty, and an empty comparison shows nothing.
SF = "/root/testdata/sf0.01"
KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df, want = plans.QUERIES[name](spark, SF), duck.sql(plans.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: KIND.get(t, t) for c, t in df.dtypes} == types
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    got = order([tuple(r[c] for c in columns) for r in df.collect()])
    held = order(duck.sql(f"SELECT {', '.join(columns)} FROM ({plans.ORACLES[name].strip()})").fetchall())
    assert got and got == held


def test_branches_appear(spark):
    kinds = lambda name, column: {r[0] for r in plans.QUERIES[name](spark, SF).select(column).distinct().collect()}
    assert kinds("progress_status", "status") == {"both", "disk_only", "record_only"}
    assert kinds("verified_files", "verdict") == {"verified", "mismatch", "unverified"}
    assert kinds("grounded_answers", "verdict") == {"answered", "insufficient_evidence"}
    assert kinds("round_status", "status") == {"ok", "at_risk", "timed_out"}
    assert kinds("sync_actions", "action") == {"add", "replace", "same", "keep"}
    assert {"api", "manual"} <= kinds("source_fallback", "tier")
