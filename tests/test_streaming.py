"""The queue as streams gives what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from sievemill.operators.queue import round_status
from sievemill.plans.queries import rounds
from sievemill.streaming import queue as streams


def test_joined_stream_equals_batch(spark, sf_dir, tmp_path):
    both = rounds(spark, sf_dir)
    pulls, pushes = both.select("task_id", "batch_id", "pull_ts"), both.where("push_ts IS NOT NULL").select("task_id", "push_ts")
    for name, rows, column in (("pulls", pulls, "pull_ts"), ("pushes", pushes, "push_ts")):
        rows.orderBy(column).coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / name))
    for name, rows, column in (("pulls", pulls, "pull_ts"), ("pushes", pushes, "push_ts")):
        streams.sentinel(spark, rows, column, "2100-01-01").write.mode("append").parquet(str(tmp_path / name))
    joined = streams.joined_rounds(streams.read_stream(spark, str(tmp_path / "pulls"), pulls.schema, 100), streams.read_stream(spark, str(tmp_path / "pushes"), pushes.schema, 100))
    got = streams.drained(streams.status_of(joined), str(tmp_path / "out"), str(tmp_path / "cp")).where("task_id >= 0")
    want = round_status(both)
    assert {(r.task_id, r.status) for r in got.collect()} == {(r.task_id, r.status) for r in want.collect()}
    assert got.count() == want.count() and got.select("status").distinct().count() == 3


def test_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), "pull"), (1, at(50), "push"), (2, at(0), "pull"), (2, at(115), "push"), (3, at(0), "pull"), (4, at(5), "push"), (5, at(0), "pull"), (5, at(121), "push")]
    schema = "task_id long, event_ts timestamp, kind string"
    events = spark.createDataFrame(rows, schema)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, dt.datetime(2100, 1, 1), "push")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.timed_rounds(streams.read_stream(spark, str(tmp_path / "in"), events.schema))
    query = out.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.task_id: r.status for r in spark.table("timed").collect()}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {1: "ok", 2: "at_risk", 3: "timed_out", 5: "timed_out"}


def test_tasks_share_a_bucket(spark, tmp_path):
    """Many tasks, few states: outcomes are as by hand, also where a pull and its push come in different batches."""
    import random

    rng, t0, rows, want = random.Random(3), dt.datetime(2024, 1, 1), [], {}
    for task in range(300):
        began, taken = rng.randrange(3_000), rng.choice([None, 0.25, 110, 110.001, 120, 120.001, 500])
        rows.append((task, t0 + dt.timedelta(seconds=began), "pull"))
        if taken is not None:
            rows.append((task, t0 + dt.timedelta(seconds=began + taken), "push"))
        want[task] = "timed_out" if taken is None or taken > 120 else "ok" if taken <= 110 else "at_risk"
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "task_id long, event_ts timestamp, kind string"
    for part in [rows[k : k + 250] for k in range(0, len(rows), 250)] + [[(-1, dt.datetime(2100, 1, 1), "push")]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    with streams.rocksdb(spark):
        got = streams.drained(streams.timed_rounds(events, buckets=3), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert len(got) == 300 and {r.task_id: r.status for r in got} == want
