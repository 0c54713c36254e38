"""Rounds of several papers open at once in a lane, from a stream of pulls and pushes."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queue import ENGINE_SECONDS
from ..tasks import send_code

#: Events of a lane may be so much older than its newest one.
DELAY_SECONDS = 600
OVERLAP = "lane long, task_id long, kind string, open_others long, late boolean"
#: Events that are told one by one at a time.
CHUNK = 100_000
_LIMIT = ENGINE_SECONDS * 1_000_000


class Lane:
    """What is open in a lane, told event by event in order of time: (time, 0 for a push or 1 for a pull, task, paper)."""

    def __init__(self, held: dict):
        #: By task: paper and when it ends at the latest.
        self.open: dict[int, list[int]] = {int(k): v for k, v in held.get("open", {}).items()}
        #: Tasks whose push came no later than their pull, until nothing can ask for them.
        self.ended: dict[int, int] = {int(k): v for k, v in held.get("ended", {}).items()}
        self.papers = Counter(p for p, _ in self.open.values())
        #: When a task may be forgotten: ends of open rounds and of `ended`; those that are gone by then are passed over.
        self.ends = [(end, t) for t, (_, end) in self.open.items()] + [(at + _LIMIT, t) for t, at in self.ended.items()]
        heapq.heapify(self.ends)

    def held(self) -> dict:
        return {"open": self.open, "ended": self.ended}

    def expire(self, now: int) -> None:
        while self.ends and self.ends[0][0] <= now:
            end, task = heapq.heappop(self.ends)
            if task in self.open and self.open[task][1] == end:
                self.close(task)
            elif task in self.ended and self.ended[task] + _LIMIT == end:
                del self.ended[task]

    def close(self, task: int) -> None:
        paper, _ = self.open.pop(task)
        self.papers[paper] -= 1
        if not self.papers[paper]:
            del self.papers[paper]

    def step(self, at: int, kind: int, task: int, paper: int) -> int | None:
        """After a pull, the number of rounds of other papers that are open."""
        self.expire(at)
        if kind == 0:
            if task in self.open:
                self.close(task)
            else:
                self.ended[task] = at
                heapq.heappush(self.ends, (at + _LIMIT, task))
            return None
        others = len(self.open) - self.papers[paper]
        if task not in self.ended and task not in self.open:
            self.open[task] = [paper, at + _LIMIT]
            self.papers[paper] += 1
            heapq.heappush(self.ends, (at + _LIMIT, task))
        return others


def in_order(parts: list[np.ndarray]) -> np.ndarray:
    """Different events (time, kind, task, paper) of all parts in order; ``parts`` is emptied.."""
    events = np.concatenate(parts)
    parts.clear()
    events = events[np.lexsort(events.T[::-1])]
    return events[np.concatenate([[True], (events[1:] != events[:-1]).any(axis=1)])[: len(events)]]


class OverlapState(StatefulProcessor):
    """Keeps a lane's events until its newest one is `DELAY_SECONDS` later, then takes them in order."""

    def __init__(self, delay: int):
        self.delay = delay * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lane", "newest long, waiting string, lane string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, waiting, held = self.state.get() if self.state.exists() else (None, "[]", "{}")
        passed = None if newest is None else newest - self.delay
        lane, parts = Lane(json.loads(held)), [np.array(json.loads(waiting), np.int64).reshape(-1, 4)]
        for part in rows:
            at = part["at"].to_numpy(np.int64)
            late = at <= passed if passed is not None else np.zeros(len(at), bool)
            if late.any():
                yield self._frame([(key[0], int(t), k, None, True) for t, k in zip(part["task_id"][late], part["kind"][late])])
            new = np.column_stack([at, (part["kind"] == "pull").to_numpy(np.int64), part["task_id"].to_numpy(np.int64), part["paper_id"].to_numpy(np.int64)])[~late]
            if len(new):
                parts.append(new)
                newest = int(new[:, 0].max()) if newest is None else max(newest, int(new[:, 0].max()))
        if newest is not None:
            events = in_order(parts)
            ripe = int(np.searchsorted(events[:, 0], newest - self.delay, "right"))
            for cut in range(0, ripe, CHUNK):
                out = []
                for event in events[cut : min(cut + CHUNK, ripe)].tolist():
                    others = lane.step(*event)
                    if others:
                        out.append((key[0], event[2], "pull", others, False))
                yield self._frame(out)
            lane.expire(newest - self.delay)
            self.state.update((newest, json.dumps(events[ripe:].tolist()), json.dumps(lane.held())))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["lane", "task_id", "kind", "open_others", "late"])
        return frame.astype({"lane": "int64", "task_id": "int64", "kind": "str", "open_others": "Int64", "late": "bool"})

    def close(self) -> None:
        pass


def overlapping_stream(events: DataFrame, delay: int = DELAY_SECONDS) -> DataFrame:
    """``lane, task_id, kind, open_others, late`` from a stream of ``lane, paper_id, task_id, kind, ts`` (kind: pull or push).

    A row for each pull that began while rounds of other papers in its lane were open, as the batch
    operator `overlapping` tells it where no round is open beyond the engine's limit; and a row with
    ``late`` for each event that came when its lane was past it by more than ``delay`` seconds: such events play no part.
    An event that is repeated counts once. Events of a lane come out once a newer one by the delay has
    come (see `lane_ends`); what is kept of a lane is what that time and the limit hold. Rows with a null
    play no part. Needs the RocksDB state store.
    """
    rows = events.where("lane IS NOT NULL AND paper_id IS NOT NULL AND task_id IS NOT NULL AND ts IS NOT NULL AND kind IN ('pull', 'push')")
    rows = rows.select(F.col("lane").cast("long").alias("lane"), F.col("paper_id").cast("long").alias("paper_id"), F.col("task_id").cast("long").alias("task_id"), "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    send_code(events.sparkSession)
    return rows.groupBy("lane").transformWithStateInPandas(OverlapState(delay), OVERLAP, "Append", "None")


def lane_ends(events: DataFrame, at: str) -> DataFrame:
    """A push for each lane at a far time, which lets all that is kept come out; its task and paper are -1."""
    far = {"task_id": F.lit(-1), "paper_id": F.lit(-1), "kind": F.lit("push"), "ts": F.lit(at).cast("timestamp")}
    lanes = events.select("lane").where("lane IS NOT NULL").distinct()
    return lanes.select(*[(far[f.name] if f.name in far else F.col("lane")).cast(f.dataType).alias(f.name) for f in events.schema])
