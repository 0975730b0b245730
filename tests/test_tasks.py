"""Tasks with timers: scripted events, and a stop in the middle."""

import datetime as dt
from unittest import mock

import pandas as pd

from quarrylane.session import shared_dir
from quarrylane.streaming.tasks import Tasks, task_stream

START = dt.datetime(2026, 1, 5, 12, 0, 0)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(spark, folder, batches, number):
    """Each batch as a file of its own, in order; all there is is taken, and the stream stopped."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(t, s, at(x)) for t, s, x in rows], "task string, state string, at timestamp").coalesce(1).write.parquet(f"{folder}/in/part={number + i:03d}")
        events = spark.readStream.schema("task string, state string, at timestamp, part int").parquet(f"{folder}/in")
        changes = task_stream(events.select("task", "state", "at"), limit=300, kept=3600)
        query = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.schema("task string, state string, progress int, at timestamp, events int, cause string").parquet(f"{folder}/out").collect()
    return sorted((r.task, int((r.at - START).total_seconds()), r.state, r.cause) for r in rows)


def test_transitions_time_outs_and_clearing_after_restarts(spark):
    """Every batch is a run of its own from the checkpoint, so that all state comes from there."""
    folder = shared_dir(spark)
    batches = [
        [("a", "READING", 0), ("b", "READING", 0), ("c", "PARSING", 5), ("c", "READING", 1)],
        [("a", "PARSING", 250), ("clock", "READING", 290)],
        [("clock", "READING", 400)],  # b and c have had no event for 300 seconds; a has
        [("a", "SUCCESS", 420), ("clock", "READING", 450)],
        [("a", "READING", 455), ("clock", "READING", 600)],  # after the end: stays as it is
        [("clock", "READING", 4100)],  # 3,600 seconds after their ends all are cleared but what was just seen
        [("clock", "READING", 4200)],
    ]
    got = run(spark, folder, batches, 0)
    of = lambda task: [x[1:] for x in got if x[0] == task]
    assert of("b") == [(0, "READING", "event"), (300, "TIMEOUT", "timer"), (3900, "TIMEOUT", "cleared")]
    assert of("c") == [(5, "PARSING", "event"), (305, "TIMEOUT", "timer"), (3905, "TIMEOUT", "cleared")]
    assert of("a") == [(0, "READING", "event"), (250, "PARSING", "event"), (420, "SUCCESS", "event"), (420, "SUCCESS", "event"), (4020, "SUCCESS", "cleared")]


def test_a_timed_out_task_may_still_end(spark):
    got = run(spark, shared_dir(spark), [[("a", "READING", 0)], [("clock", "READING", 400)], [("clock", "READING", 401)], [("a", "SUCCESS", 410)]], 0)
    assert [x[1:] for x in got if x[0] == "a"] == [(0, "READING", "event"), (300, "TIMEOUT", "timer"), (410, "SUCCESS", "event")]


def test_a_new_task_takes_few_trips_to_the_store():
    """Each call of the handle or a state is a trip: their number doesn't grow with a task's events."""
    handle, tasks = mock.MagicMock(), Tasks()
    latest, history = mock.MagicMock(), mock.MagicMock()
    latest.exists.return_value = False
    handle.getValueState.return_value, handle.getListState.return_value = latest, history
    tasks.init(handle)
    for mocked in (handle, latest, history):
        mocked.reset_mock()
    rows = pd.DataFrame({"state": ["READING"] * 40, "at": [at(k) for k in range(40)]})
    (row,) = tasks.handleInputRows(("a",), iter([rows[:10], rows[10:]]), None)
    assert row["events"].tolist() == [40] and row["state"].tolist() == ["READING"] and len(history.appendList.call_args.args[0]) == 40
    assert sum(len(x.method_calls) for x in (handle, latest, history)) == 4
