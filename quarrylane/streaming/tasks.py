"""Tasks as state of a stream: transitions, time-outs by timers, and states that go after a while.

Each task has its latest state, its history and one timer. Events come in any order within the watermark's delay; a task
that isn't finished and has had no event for the limit is timed out by its timer, which fires as event time passes, with or
without further events of the task. A finished task's state is cleared once it has been kept for its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylane.streaming.ingest import PROGRESS

#: Seconds without an event after which a task is timed out, and that a finished task is kept.
LIMIT, KEPT = 300, 3600
ENDED = ("SUCCESS", "FAILURE", "TIMEOUT")
OUT = "task string, state string, progress int, at timestamp, events int, cause string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Tasks(StatefulProcessor):
    """Value state (state, at), list state (the history), one event-time timer: the time-out, then the end of its keeping."""

    def __init__(self, limit: int = LIMIT, kept: int = KEPT):
        self.limit, self.kept = limit * 1000, kept * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "state string, at long")
        self.history = handle.getListState("history", "state string, at long")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _row(self, task: str, state: str, at: int, events: int, cause: str) -> pd.DataFrame:
        progress = 100 if state in ENDED else PROGRESS.get(state)
        return pd.DataFrame({"task": [task], "state": [state], "progress": [progress], "at": [pd.Timestamp(at, unit="ms")], "events": [events], "cause": [cause]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        new = sorted((int(pd.Timestamp(at).value // 1_000_000), str(state)) for at, state in zip(came["at"], came["state"], strict=True))
        last = self.latest.get() if self.latest.exists() else None
        state, at = (last[0], int(last[1])) if last else (None, -1)
        self.history.appendList([(name, when) for when, name in new])
        for when, name in new:
            if state in ENDED and state != "TIMEOUT":
                continue  # what has ended stays as it is; a timed-out task may still be finished by a late event
            if when >= at:
                state, at = name, when
        self.latest.update((state, at))
        due = at + (self.kept if state in ENDED else self.limit)
        if last is None:  # a task that is new, or was cleared, has neither a timer nor a history: each call is a trip to the store
            self.handle.registerTimer(due)
        else:
            self._timer(due)
        yield self._row(key[0], state, at, len(new) if last is None else sum(1 for _ in self.history.get()), "event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, at = self.latest.get() if self.latest.exists() else (None, 0)
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        events = sum(1 for _ in self.history.get()) if self.history.exists() else 0
        if state is None or state in ENDED:
            self.latest.clear()
            self.history.clear()
            yield self._row(key[0], state or "TIMEOUT", due, events, "cleared")
        else:
            self.latest.update(("TIMEOUT", due))
            self.handle.registerTimer(due + self.kept)
            yield self._row(key[0], "TIMEOUT", due, events, "timer")

    def close(self) -> None:
        pass


def task_stream(events: DataFrame, limit: int = LIMIT, kept: int = KEPT, late: str = "10 seconds") -> DataFrame:
    """Changes of tasks (task, state, progress, at, events, cause) of a stream of events (task string, state string, at timestamp).

    cause is event, timer (timed out after `limit` seconds without an event) or cleared (`kept` seconds after its end). Rows
    with nulls are left out. The session's state store has to be RocksDB's; with_state_store() sees to that.
    """
    with_state_store(events.sparkSession)
    sound = events.where("task is not null and state is not null and at is not null").withWatermark("at", late)
    return sound.groupBy("task").transformWithStateInPandas(Tasks(limit, kept), OUT, "Append", "EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state with timers needs; another one that was chosen is left alone."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark
