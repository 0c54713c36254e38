"""The translation queue as streams: pulls and pushes joined in event time, and a timer for each open round."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.queue import ENGINE_SECONDS, ROUND_SECONDS
from ..tasks import send_code

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of tasks that share a state.
BUCKETS = 2048
#: Event time may be out of order by so much.
DELAY = "10 minutes"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def joined_rounds(pulls: DataFrame, pushes: DataFrame, hard: int = ENGINE_SECONDS) -> DataFrame:
    """Each pull with its first push within the hard limit, or none: ``task_id, batch_id, pull_ts, push_ts``, one row a pull.

    Both inputs are streams with TIMESTAMP event times. A pull comes out when the watermark has passed
    its limit, as only then it's known which push was the first, so the last rounds wait for later events
    (see `drained`). Repeated pulls are one.
    """
    a = pulls.withWatermark("pull_ts", DELAY)
    b = pushes.select(F.col("task_id").alias("t"), "push_ts").withWatermark("push_ts", DELAY)
    near = F.expr(f"task_id = t AND push_ts >= pull_ts AND push_ts <= pull_ts + INTERVAL {hard} SECONDS")
    met = a.join(b, near, "leftOuter").select("task_id", "batch_id", "pull_ts", "push_ts")
    return met.groupBy("task_id", "batch_id", "pull_ts").agg(F.min("push_ts").alias("push_ts"))


def status_of(rounds: DataFrame, soft: int = ROUND_SECONDS) -> DataFrame:
    in_time = F.col("push_ts") <= F.col("pull_ts") + F.expr(f"INTERVAL {soft} SECONDS")
    return rounds.withColumn("status", F.when(F.col("push_ts").isNull(), "timed_out").when(in_time, "ok").otherwise("at_risk"))


def sentinel(spark: SparkSession, like: DataFrame, time_col: str, at: str) -> DataFrame:
    """One row far in the future, which moves the watermark past all rounds; its task_id is -1."""
    values = [F.lit(-1).cast(f.dataType) if f.name == "task_id" else F.lit(at).cast(f.dataType) if f.name == time_col else F.lit(None).cast(f.dataType) for f in like.schema]
    return spark.range(1).select(*[v.alias(f.name) for v, f in zip(values, like.schema)])


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there, exactly once into Parquet, and read the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class OpenRounds(StatefulProcessor):
    """Holds the pulls of a bucket of tasks until each one's push comes or its limit passes in event time.

    Input rows: ``bucket, task_id, event_ts, kind`` with kind pull or push. Output: ``task_id, latency, status``.
    A push without a pull is ignored, as is anything after a task's outcome but a new pull. A bucket has one
    timer, for the limit that passes first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pulled = handle.getValueState("pulled", "tasks binary, at binary")

    def _held(self) -> dict[int, int]:
        """By task when its open round was pulled, in microseconds."""
        if not self.pulled.exists():
            return {}
        tasks, at = self.pulled.get()
        return dict(zip(np.frombuffer(tasks, np.int64).tolist(), np.frombuffer(at, np.int64).tolist()))

    def _hold(self, held: dict[int, int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not held:
            self.pulled.clear()
            return
        self.pulled.update((np.array(list(held), np.int64).tobytes(), np.array(list(held.values()), np.int64).tobytes()))
        self.handle.registerTimer(_deadline(min(held.values())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, done = self._held(), []
        events = pd.concat([part[["task_id", "at", "kind"]] for part in rows]).sort_values(["at", "kind"])
        for task, at, kind in zip(events["task_id"].tolist(), events["at"].tolist(), events["kind"].tolist()):
            if kind == "pull":
                held.setdefault(task, at)
            elif task in held:
                taken = (at - held[task]) / 1e6
                if taken <= ENGINE_SECONDS:
                    del held[task]
                    done.append((task, taken, "ok" if taken <= ROUND_SECONDS else "at_risk"))
        self._hold(held)
        yield pd.DataFrame(done, columns=OUTCOME).astype({"task_id": "int64", "latency": "float64", "status": "str"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        late = [task for task, at in held.items() if _deadline(at) <= now]
        for task in late:
            del held[task]
        self._hold(held)
        yield pd.DataFrame({"task_id": np.array(late, np.int64), "latency": np.full(len(late), np.nan), "status": ["timed_out"] * len(late)}).astype({"status": "str"})

    def close(self) -> None:
        pass


def _deadline(at: int) -> int:
    """When a round pulled ``at`` (microseconds) is over at the latest, in milliseconds."""
    return at // 1000 + ENGINE_SECONDS * 1000 + 1


OUTCOME = ["task_id", "latency", "status"]


def timed_rounds(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Outcome of each task by event-time timers. events: a stream of ``task_id, event_ts, kind``. Needs the RocksDB state store.

    Tasks share a state and a timer by ``buckets``, as a call of Python for each task takes longer than its work.
    """
    send_code(events.sparkSession)
    keyed = events.withWatermark("event_ts", DELAY).where("task_id IS NOT NULL AND event_ts IS NOT NULL")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")).withColumn("at", F.unix_micros("event_ts")).groupBy("bucket")
    return keyed.transformWithStateInPandas(OpenRounds(), "task_id long, latency double, status string", "Append", "EventTime")
