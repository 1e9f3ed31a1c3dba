"""Live status: stored task rows beside reported progress, on tables and on two streams."""

import datetime as dt
import random

from diffloom import schemas
from diffloom.operators import lifecycle
from diffloom.streaming import lifecycle as stream
from diffloom.streaming import status

START = dt.datetime(2024, 1, 1)
CHANGES = "id string, updated_at timestamp, status string, error_message string"


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def change_rows(spark, rows):
    """(task, seconds, status, error)"""
    return spark.createDataFrame([(t, at(s), state, error) for t, s, state, error in rows], CHANGES)


def event_rows(spark, rows):
    """(task, number, seconds, progress)"""
    full = [(t, n, at(s), None, progress, "reviewing", "m") for t, n, s, progress in rows]
    return spark.createDataFrame(full, schemas.TASK_EVENTS)


def found(frame):
    return {r["task_id"]: (r["known"], r["status"], r["error_message"], r["progress"], r["reported_at"]) for r in frame.collect()}


def test_tasks_and_progress_that_only_one_side_knows(spark):
    changes = change_rows(spark, [("a", 0, "pending", None), ("a", 9, "processing", None), ("b", 5, "failed", "broke"),
                                  ("c", 7, "completed", None), ("c", 7, "processing", None), (None, 1, "failed", "x"),
                                  ("n", None, "failed", "x"), ("s", 3, None, None)])
    events = event_rows(spark, [("a", 1, 4, 30), ("a", 2, 4, 40), ("a", 3, 99, None), ("z", 1, 5, 120), (None, 1, 1, 7), ("n", 1, None, 5)])
    assert found(lifecycle.live_status(changes, events)) == {
        "a": (True, "processing", None, 40, at(4)),  # of two reports at one time the later number counts
        "b": (True, "failed", "broke", None, None),  # never reported
        "c": (True, "completed", None, None, None),  # of two changes at one time the end counts
        "s": (True, None, None, None, None),
        "z": (False, None, None, 120, at(5)),  # not stored
    }
    assert found(lifecycle.live_status(changes.limit(0), events.limit(0))) == {}


class Feeds:
    """Two streams that grow file by file; each call is one run of the query over what is new."""

    def __init__(self, spark, tmp_path, **settings):
        self.spark, self.settings = spark, settings
        self.tasks, self.events, self.out, self.state = (str(tmp_path / n) for n in ("tasks", "events", "out", "state"))

    def send(self, changes, events):
        change_rows(self.spark, changes).coalesce(1).write.mode("append").parquet(self.tasks)
        event_rows(self.spark, events).coalesce(1).write.mode("append").parquet(self.events)
        tasks = self.spark.readStream.schema(CHANGES).parquet(self.tasks)
        reports = stream.read_task_events(self.spark, self.events)
        status.start_live_status(tasks, reports, self.out, self.state, **self.settings).awaitTermination()
        return found(status.read_live_status(self.spark, self.out))


def test_windows_come_out_when_both_streams_have_passed(spark, tmp_path):
    feeds = Feeds(spark, tmp_path, task_watermark="10 seconds", event_watermark="30 seconds")
    first = feeds.send([("a", 5, "processing", None), ("b", 6, "pending", None), ("e", 200, None, None)],
                       [("a", 1, 20, 10), ("z", 1, 30, 50), ("e", 1, 80, None)])
    assert first == {}  # events stand at 50 s, the first window ends at 60 s
    second = feeds.send([("a", 230, "completed", None)], [("a", 2, 100, 90), ("e", 2, 130, None)])
    assert second == {"a": (True, "processing", None, 10, at(20)), "b": (True, "pending", None, None, None), "z": (False, None, None, 50, at(30))}
    third = feeds.send([("e", 1000, None, None)], [("e", 3, 1000, None)])
    assert third["a"] == (True, "completed", None, 90, at(100)) and third["z"] == second["z"]


def test_stream_equals_table(spark, tmp_path):
    dice = random.Random(3)
    states = ["pending", "processing", "completed", "failed", None]
    feeds = Feeds(spark, tmp_path)
    all_changes, all_events = [], []
    for part in range(2):
        changes = [(dice.choice("abcdefgh"), part * 600 + dice.randrange(600), dice.choice(states), None) for _ in range(25)]
        events = [(dice.choice("efghijkl"), part * 1000 + n, part * 600 + dice.randrange(600), dice.choice([None, 5, 50, 130])) for n in range(40)]
        feeds.send(changes, events + events[:5])  # some reports are delivered twice
        all_changes, all_events = all_changes + changes, all_events + events
    end = feeds.send([(None, 90000, None, None)], [(None, 0, 90000, None)])
    assert end == found(lifecycle.live_status(change_rows(spark, all_changes), event_rows(spark, all_events)))
