"""Queries on who read what the cache had at the time, derived from every event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import queue
from ..sources.tables import read_table
from ..storage import fresh_path
from ..streaming import overlaps
from ..streaming import queue as streams

#: A text for each kind of event, half of all events ask for one of two.
TEXT = "CASE WHEN event_id % 2 = 0 THEN concat('common text ', event_id % 4) ELSE concat(event_type, ' text ', user_id % 7) END"


def poisoned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event looks its text up, and writes it to the cache a little later, some at the same time; every 17th writes the source, as it timed out."""
    events = read_table(spark, sf_dir, "events").selectExpr("event_id", "user_id * 10 + event_id % 3 AS batch_id", f"{TEXT} AS source_text", "date_trunc('minute', cast(ts AS timestamp)) AS at")
    lookups = events.selectExpr("batch_id", "source_text", "at AS ts")
    writes = events.selectExpr("event_id AS entry_id", "batch_id", "source_text", "CASE WHEN event_id % 17 = 0 THEN source_text ELSE upper(source_text) END AS target_text", "at + INTERVAL 5 MINUTES AS ts")
    return queue.poisoned_reads(lookups, writes).selectExpr("batch_id", "entry_id", "spoilt_by", "lookups", "unix_micros(first_ts) AS first_us")


READS = f"""
WITH e AS (
  SELECT event_id, user_id * 10 + event_id % 3 AS batch_id, {TEXT} AS source_text, date_trunc('minute', ts) AS at FROM events
), found AS (
  SELECT l.event_id AS lookup, l.batch_id, l.at, max([epoch_us(w.at), w.event_id]) AS latest
  FROM e l JOIN e w ON w.source_text = l.source_text AND w.at + INTERVAL 5 MINUTES < l.at GROUP BY ALL
)
SELECT f.batch_id, w.event_id AS entry_id, w.batch_id AS spoilt_by, count(*) AS lookups, min(epoch_us(f.at)) AS first_us
FROM found f JOIN e w ON w.event_id = f.latest[2] WHERE w.event_id % 17 = 0 AND w.batch_id <> f.batch_id GROUP BY 1, 2, 3
"""

def streamed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulls and pushes of all rounds as a stream, every fourth push twice: rounds that began while others of their lane were open."""
    base = fresh_path(spark, "lanes")
    rounds = read_table(spark, sf_dir, "events").selectExpr("user_id % 10 AS lane", "user_id AS paper_id", "event_id AS task_id", "cast(ts AS timestamp) AS pull_ts", "CASE WHEN event_id % 17 <> 0 THEN cast(ts AS timestamp) + make_dt_interval(0, 0, 0, event_id % 131) END AS push_ts")
    pulls = rounds.selectExpr("lane", "paper_id", "task_id", "'pull' AS kind", "pull_ts AS ts")
    pushes = rounds.where("push_ts IS NOT NULL").selectExpr("lane", "paper_id", "task_id", "'push' AS kind", "push_ts AS ts")
    events = pulls.unionByName(pushes).unionByName(pushes.where("task_id % 4 = 0"))
    events.unionByName(overlaps.lane_ends(pulls, "2100-01-01")).write.parquet(f"{base}/events")
    with streams.rocksdb(spark):
        done = streams.drained(overlaps.overlapping_stream(streams.read_stream(spark, f"{base}/events", events.schema, 1000)), f"{base}/out", f"{base}/checkpoint")
    return done.where("NOT late").select("task_id", "open_others")


STREAMED = """
WITH spans AS (
  SELECT event_id AS task_id, user_id % 10 AS lane, user_id AS paper_id, ts AS pull_ts,
         CASE WHEN event_id % 17 <> 0 THEN ts + to_seconds(least(event_id % 131, 120)) ELSE ts + INTERVAL 120 SECONDS END AS end_ts FROM events
)
SELECT a.task_id, count(*) AS open_others
FROM spans a JOIN spans b ON a.lane = b.lane AND a.paper_id <> b.paper_id AND (b.pull_ts < a.pull_ts OR (b.pull_ts = a.pull_ts AND b.task_id < a.task_id)) AND b.end_ts > a.pull_ts
GROUP BY 1
"""

QUERIES = {"poisoned_reads": poisoned_reads, "streamed_overlaps": streamed_overlaps}
ORACLES = {"poisoned_reads": READS, "streamed_overlaps": STREAMED}
