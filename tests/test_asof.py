"""As-of joins against nested loops, with hot keys cut by ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sievemill.operators import asof, queue
from sievemill.operators.asof import as_of

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("size", [250_000, 60])
def test_against_loops(spark, monkeypatch, size):
    monkeypatch.setattr(asof, "RANGE_ROWS", size)
    rng = random.Random(4)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(200)) if rng.random() > 0.02 else None
    key = lambda: rng.choice(["hot"] * 6 + [f"k{rng.randrange(15)}", None])
    rows = [(k % 380, key(), at()) for k in range(400)] + [(999, "hot", T0)] * 30
    writes = [(k, key(), at(), rng.choice([None, "x", "y"])) for k in range(500)] + [(1000 + k, "late", T0 + dt.timedelta(days=1), "z") for k in range(3)] + [(5000, "early", T0 - dt.timedelta(days=1), "w")]
    rows += [(2000, "early", T0 + dt.timedelta(days=2)), (2001, "late", T0 + dt.timedelta(days=1)), (2002, "late", T0 + dt.timedelta(days=2))]
    a = spark.createDataFrame(rows, "id long, k string, at timestamp").withColumn("part", F.lit(1)).withColumn("kind", F.lit("x"))
    b = spark.createDataFrame(writes, "entry long, k string, at timestamp, note string")
    got = sorted([(r.id, r.k, r.at, r.latest.entry if r.latest else None, r.latest.note if r.latest else None) for r in as_of(a, b, "k", "at", ["entry"]).collect()], key=str)
    want = []
    for i, k, t in rows:
        past = [(wt, e, n) for e, wk, wt, n in writes if k is not None and t is not None and wk == k and wt is not None and wt < t]
        want.append((i, k, t, *(max(past, key=lambda x: x[:2])[1:] if past else (None, None))))
    assert got == sorted(want, key=str) and sum(g[3] is not None for g in got) > 200


def test_who_read_a_poisoned_entry(spark):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    writes = [(1, "b1", "air and health", "Luft", m(0)), (2, "b2", "air and health", "air and health", m(10)), (3, "b3", "air and health", "Luft", m(30)), (4, "b2", "E=1", "E=1", m(10)), (5, "b2", "noise", None, m(10)), (6, "b9", None, None, m(10))]
    lookups = [("b3", "air and health", m(5)), ("b4", "air and health", m(20)), ("b4", "air and health", m(21)), ("b2", "air and health", m(22)), ("b5", "air and health", m(30)), ("b6", "air and health", m(31)), ("b7", "E=1", m(20)), ("b8", "noise", m(20)), ("b8", None, m(20)), (None, "air and health", m(25))]
    got = queue.poisoned_reads(spark.createDataFrame(lookups, "batch_id string, source_text string, ts timestamp"), spark.createDataFrame(writes, "entry_id long, batch_id string, source_text string, target_text string, ts timestamp"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("b4", 2, "b2", 2, m(20)), ("b5", 2, "b2", 1, m(30)), (None, 2, "b2", 1, m(25))], key=str)
