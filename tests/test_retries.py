"""Retries on a stream: due after a minute, in order, counted once; late events set aside; state that ends."""

import datetime as dt
import random

from pyspark.sql import functions as F

from diffloom import schemas
from diffloom.operators import lifecycle
from diffloom.streaming import lifecycle as stream
from diffloom.streaming import retries

START = dt.datetime(2024, 1, 1)


class Feed:
    """Events that arrive file by file; each call is one run of the query over what is new."""

    def __init__(self, spark, tmp_path, **settings):
        self.spark, self.settings = spark, settings
        self.source, self.out, self.state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def send(self, *rows):
        """(task, seq, seconds since the start, state)"""
        full = [(t, n, START + dt.timedelta(seconds=at), state, None, None, None) for t, n, at, state in rows]
        self.spark.createDataFrame(full, schemas.TASK_EVENTS).coalesce(1).write.mode("append").parquet(self.source)
        retries.start_retries(stream.read_task_events(self.spark, self.source), self.out, self.state, **self.settings).awaitTermination()
        return self

    def due(self):
        rows = self.spark.read.parquet(f"{self.out}/due").collect()
        return sorted((r["task_id"], r["seq"], r["attempt"], r["retry_allowed"], (r["retry_at"] - START).total_seconds()) for r in rows)

    def late(self):
        return sorted((r["task_id"], r["seq"]) for r in self.spark.read.parquet(f"{self.out}/late").collect())


def test_due_after_a_minute_and_the_fourth_fails(spark, tmp_path):
    feed = Feed(spark, tmp_path, watermark="10 seconds")
    feed.send(*[("t", n, 100 + n, "retry") for n in range(4)], ("u", 9, 160, "processing"))
    assert feed.due() == []  # the watermark stands at 150 s, the first is due at 160 s
    feed.send(("u", 10, 171, "completed"))
    assert feed.due() == [("t", 0, 2, True, 160.0), ("t", 1, 3, True, 161.0)]
    feed.send(("u", 11, 500, "completed"))
    assert feed.due()[2:] == [("t", 2, 4, True, 162.0), ("t", 3, 5, False, 163.0)] and feed.late() == []


def test_redeliveries_count_once_and_late_events_are_set_aside(spark, tmp_path):
    feed = Feed(spark, tmp_path, watermark="10 seconds")
    feed.send(("t", 1, 100, "retry"), ("t", 1, 100, "retry"), ("t", 2, 105, "retry"))
    feed.send(("t", 2, 105, "retry"), ("u", 5, 300, "processing"))
    assert [r[:3] for r in feed.due()] == [("t", 1, 2), ("t", 2, 3)]
    # Copies of what was counted, an event never seen before, and a new one.
    feed.send(("t", 1, 100, "retry"), ("t", 7, 150, "retry"), ("t", 8, 295, "retry"))
    feed.send(("u", 6, 900, "processing"))
    assert [r[:3] for r in feed.due()] == [("t", 1, 2), ("t", 2, 3), ("t", 8, 4)]
    assert feed.late() == [("t", 7)]


def test_state_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, watermark="10 seconds", remember="2 minutes", lifetime="1 hour")
    feed.send(("t", 1, 100, "retry"), ("t", 2, 101, "retry")).send(("u", 3, 3000, "processing"))
    feed.send(("t", 4, 3001, "retry")).send(("u", 5, 4000, "processing"))
    assert [r[:3] for r in feed.due()] == [("t", 1, 2), ("t", 2, 3), ("t", 4, 4)]  # two minutes forget copies, not the count
    feed.send(("u", 6, 20000, "processing")).send(("t", 7, 20001, "retry")).send(("u", 8, 30000, "processing"))
    assert feed.due()[-1][:3] == ("t", 7, 2)  # an hour without events forgets the task


def test_equals_the_batch_answer(spark, tmp_path):
    """Out of order within the watermark, over several files, with a hot task."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"t{rng.randrange(15)}", n, 10 * n + rng.randrange(200), rng.choice(["retry", "processing"]))
            for n in range(300)]
    rows.sort(key=lambda r: r[2] + rng.randrange(300))
    feed = Feed(spark, tmp_path, watermark="10 minutes")
    for at in range(0, 300, 100):
        feed.send(*rows[at : at + 100], *rows[max(0, at - 20) : at])
    feed.send(("end", 999, 100000, "processing"))
    batch = lifecycle.attempts(spark.read.schema(schemas.TASK_EVENTS).parquet(feed.source)).where("state = 'retry'")
    wanted = batch.select("task_id", "seq", "attempt", "retry_allowed", F.col("retry_at")).collect()
    assert feed.due() == sorted((r["task_id"], r["seq"], r["attempt"], r["retry_allowed"], (r["retry_at"] - START).total_seconds()) for r in wanted)
    assert feed.late() == []
