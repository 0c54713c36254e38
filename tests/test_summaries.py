"""Sketches by case against exact SQL, within their stated errors; adding a case touches nothing else."""

import os

import duckdb
import pytest

from sievemill.operators import summaries
from sievemill.operators.summaries import DISTINCT_ERROR, RANK_ERROR, Summaries
from sievemill.plans.summary_queries import case_summaries


def test_bounds_against_exact_sql(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW e AS SELECT 'case' || user_id % 5 AS case_name, event_type AS g, event_id // 3 AS member, value FROM '{sf}/events.parquet'")
    checked = 0
    for r in case_summaries(spark, sf).collect():
        where = " AND ".join(["true"] + ([f"case_name = '{r.case_name}'"] if r.level in (0, 1) else []) + ([f"g = '{r.group}'"] if r.level in (0, 2) else []))
        rows, members = con.sql(f"SELECT count(*), count(DISTINCT member) FROM e WHERE {where}").fetchall()[0]
        assert r.rows == rows and abs(r.members - members) <= DISTINCT_ERROR * members
        for q, value in ((0.5, r.q50), (0.9, r.q90)):
            below, upto = con.sql(f"SELECT count(*) FILTER (value < {value}), count(*) FILTER (value <= {value}) FROM e WHERE {where}").fetchall()[0]
            assert below / rows - RANK_ERROR <= q <= upto / rows + RANK_ERROR
        checked += 1
    assert checked == 25 + 5 + 5 + 1


SCHEMA = "`group` string, member long, value double, item string"


def test_a_case_is_added_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(summaries, "KEPT_ITEMS", 3)
    kept = Summaries(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError, match="no case"):
        kept.report()
    first = [("g", k % 7, float(k), f"i{k % 5}") for k in range(100)] + [(None, None, None, None), ("h", 1, None, "i9")]
    kept.add("one", spark.createDataFrame(first, SCHEMA))
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{tmp_path}/s/data") for f in fs}
    assert kept.add("two", spark.createDataFrame([("g", 6 + k, float(k), "i1" if k % 2 else f"j{k}") for k in range(50)], SCHEMA)) == 2
    assert all(os.stat(p).st_mtime_ns == t for p, t in before.items())
    got = {(r.case_name, r.group, r.level): r for r in kept.report().collect()}
    assert got[None, None, 3].rows == 152 and got[None, None, 3].members == 56 and got["one", "g", 0].members == 7 and got["one", "h", 0].q50 is None
    assert got["one", None, 0].rows == 1 and got["one", None, 1].rows == 102 and abs(got["one", "g", 0].q50 - 49) <= 2
    true = {f"i{k}": 20 for k in range(5)} | {"i9": 1} | {f"j{k}": 1 for k in range(0, 50, 2)}
    true["i1"] += 25
    top = kept.frequent(30).collect()
    assert top[0].item == "i1" and top[0].at_least == 45 and all(r.at_least <= true[r.item] <= r.at_most for r in top)
    kept.add("two", spark.createDataFrame([], SCHEMA))  # again: it takes its former place
    assert {r.rows for r in kept.report().where("level = 3").collect()} == {102}
    assert {r.rows for r in kept.report(version=2).where("level = 3").collect()} == {152}


def test_sql_of_frequent_items_states_the_same_rule(spark):
    """More items a case and group than are kept, so that what was left out counts."""
    from sievemill.plans import summary_queries

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    got = [(r.item, r.at_least, r.at_most, r["rank"]) for r in summary_queries.frequent_items(spark, sf).collect()]
    assert sorted(got) == sorted(con.sql(summary_queries.ORACLES["frequent_items"]).fetchall()) and len(got) == 10 and all(b < c for _, b, c, _ in got)
