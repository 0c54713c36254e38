"""The stream of overlaps against the batch operator: out of order, repeated and late events, and a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sievemill.operators.queue import ENGINE_SECONDS, overlapping
from sievemill.streaming import queue as streams
from sievemill.streaming.overlaps import Lane, lane_ends, overlapping_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "lane long, paper_id long, task_id long, kind string, ts timestamp"


def some_rounds(rng, n):
    rounds = []
    for task in range(n):
        begin = T0 + dt.timedelta(seconds=rng.randrange(3 * n))
        end = begin + dt.timedelta(seconds=rng.choice([0, 0, 5, 40, 119, 120, 121, 300])) if rng.random() < 0.8 else None
        rounds.append((rng.choice([1, 1, 1, 2, 3]), rng.randrange(6), task, begin, end))
    return rounds


def batch(spark, rounds):
    """With no round open beyond the limit, which is all a stream can wait for."""
    limit = F.expr(f"least(coalesce(push_ts, pull_ts + INTERVAL {ENGINE_SECONDS} SECONDS), pull_ts + INTERVAL {ENGINE_SECONDS} SECONDS)")
    table = spark.createDataFrame(rounds, "lane long, paper_id long, task_id long, pull_ts timestamp, push_ts timestamp").withColumn("push_ts", limit)
    return {(r.task_id, r.open_others) for r in overlapping(table, "lane").collect()}


def events_of(rounds):
    found = [(lane, paper, task, "pull", begin) for lane, paper, task, begin, _ in rounds]
    return found + [(lane, paper, task, "push", end) for lane, paper, task, _, end in rounds if end]


def run(spark, base):
    with streams.rocksdb(spark):
        events = streams.read_stream(spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema, 1)
        return streams.drained(overlapping_stream(events), f"{base}/out", f"{base}/cp").collect()


def write(spark, base, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(7)
    rounds = some_rounds(rng, 400)
    events = sorted(events_of(rounds), key=lambda e: e[4])
    base = str(tmp_path)
    for k in range(0, len(events), 150):  # near order, mixed up inside, every fifth event again
        part = events[k : k + 150]
        part += part[::5]
        rng.shuffle(part)
        write(spark, base, [*part, (None, 1, 1, "pull", T0), (1, None, 1, "pull", T0), (1, 1, 1, "pull", None), (1, 1, 1, "other", T0)])
        got = run(spark, base)  # each run goes on where the last one stopped
    pulls = spark.createDataFrame(events, SCHEMA)
    write(spark, base, [tuple(r) for r in lane_ends(pulls, "2100-01-01").collect()])
    got = run(spark, base)
    assert {(r.task_id, r.open_others) for r in got if not r.late} == batch(spark, rounds)
    assert len([r for r in got if not r.late]) == len({r.task_id for r in got if not r.late}) > 50 and not [r for r in got if r.late]


def test_late_events_are_kept_aside(spark, tmp_path):
    rounds = [(1, 1, 1, T0, T0 + dt.timedelta(seconds=60)), (1, 2, 2, T0 + dt.timedelta(seconds=30), T0 + dt.timedelta(seconds=70)), (1, 3, 3, T0 + dt.timedelta(hours=1), None), (2, 1, 9, T0 + dt.timedelta(seconds=1), None)]
    base = str(tmp_path)
    write(spark, base, events_of(rounds))
    run(spark, base)
    write(spark, base, [(1, 5, 5, "pull", T0 + dt.timedelta(seconds=40)), (1, 1, 1, "pull", T0), (2, 8, 8, "pull", T0 + dt.timedelta(seconds=2))])
    run(spark, base)
    write(spark, base, [tuple(r) for r in lane_ends(spark.createDataFrame(events_of(rounds), SCHEMA), "2100-01-01").collect()])
    got = run(spark, base)
    assert {(r.task_id, r.kind) for r in got if r.late} == {(5, "pull"), (1, "pull")} and all(r.open_others is None for r in got if r.late)
    assert {(r.task_id, r.open_others) for r in got if not r.late} == {(2, 1), (8, 1)} == batch(spark, [*rounds, (2, 8, 8, T0 + dt.timedelta(seconds=2), None)])


def test_a_lane_forgets():
    lane = Lane({})
    for k in range(1_000):
        lane.step(k * 1_000_000, k % 2, k // 2 * 2 if k % 3 else k, k % 5)
    assert len(lane.open) + len(lane.ended) <= 260 and sum(lane.papers.values()) == len(lane.open)
    lane.expire(10**12)
    assert lane.held() == {"open": {}, "ended": {}}


def test_one_row_a_pull(spark, tmp_path):
    s = lambda k: T0 + dt.timedelta(seconds=k)
    pulls = spark.createDataFrame([(1, 1, s(0)), (2, 1, s(0)), (3, 1, s(0)), (4, 1, s(0)), (4, 1, s(0))], "task_id long, batch_id long, pull_ts timestamp")
    pushes = spark.createDataFrame([(1, s(115)), (1, s(20)), (1, s(119)), (2, s(121)), (2, s(118)), (3, s(130)), (3, s(140)), (4, s(1)), (4, s(1))], "task_id long, push_ts timestamp")
    for name, rows, column in (("pulls", pulls, "pull_ts"), ("pushes", pushes, "push_ts")):
        rows.unionByName(streams.sentinel(spark, rows, column, "2100-01-01")).write.parquet(f"{tmp_path}/{name}")
    joined = streams.joined_rounds(streams.read_stream(spark, f"{tmp_path}/pulls", pulls.schema), streams.read_stream(spark, f"{tmp_path}/pushes", pushes.schema))
    got = streams.drained(streams.status_of(joined), f"{tmp_path}/out", f"{tmp_path}/cp").where("task_id > 0").collect()
    assert sorted((r.task_id, r.push_ts, r.status) for r in got if r.push_ts) == [(1, s(20), "ok"), (2, s(118), "at_risk"), (4, s(1), "ok")]
    assert [(r.task_id, r.status) for r in got if not r.push_ts] == [(3, "timed_out")]


def test_a_lane_of_many_events_takes_little_room():
    """Events that a batch brings are held as numbers, not as objects."""
    import tracemalloc

    import numpy as np

    from sievemill.streaming.overlaps import in_order

    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, (2_000, 4)) for _ in range(100)] + [np.zeros((0, 4), np.int64)]
    want = sorted({tuple(e) for p in parts for e in p.tolist()})
    assert [tuple(e) for e in in_order(parts).tolist()] == want and not parts
    assert in_order([np.zeros((0, 4), np.int64)]).shape == (0, 4)
    parts = [rng.integers(0, 10**15, (2_000, 4)) for _ in range(100)]
    tracemalloc.start()
    found = in_order(parts)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(found) == 200_000 and peak < 200_000 * 120
