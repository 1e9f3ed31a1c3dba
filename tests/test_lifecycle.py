import datetime as dt
import random

from pyspark.sql import functions as F

from diffloom import schemas
from diffloom.operators import lifecycle
from diffloom.streaming import lifecycle as stream

START = dt.datetime(2024, 1, 1)


def events(spark, *rows):
    full = [(t, n, START + dt.timedelta(minutes=n), state, progress, None, message) for n, (t, state, progress, message) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.TASK_EVENTS)


def one(spark, *rows):
    return lifecycle.fold_tasks(events(spark, *[("t", *r) for r in rows])).first()


def test_fold_states(spark):
    row = one(spark, ("pending", None, None), ("processing", None, None), (None, 140, "half"))
    assert (row["status"], row["progress"], row["retry_count"]) == ("processing", 100, 0)
    assert row["started_at"] == START + dt.timedelta(minutes=1) and row["completed_at"] is None
    row = one(spark, ("processing", None, None), (None, 40, None), ("failed", None, "boom"))
    assert (row["status"], row["progress"], row["error_message"]) == ("failed", 40, "boom")
    row = one(spark, ("processing", None, None), ("completed", None, None))
    assert (row["status"], row["progress"]) == ("completed", 100)
    assert one(spark, (None, 5, "x"))["status"] == "pending"


def test_fold_retries(spark):
    assert one(spark, *[("retry", None, None)] * 3)["status"] == "retry"
    row = one(spark, *[("retry", None, None)] * 4)
    assert (row["status"], row["retry_count"]) == ("failed", 4)


def test_fold_ignores_arrival_order(spark):
    rng = random.Random(5)
    states = ["processing", "retry", "completed", "failed", None]
    table = events(spark, *[(f"t{rng.randrange(9)}", rng.choice(states), rng.choice([None, 30, 200]), "m") for _ in range(400)])
    straight, shuffled = lifecycle.fold_tasks(table), lifecycle.fold_tasks(table.orderBy(F.rand(7)).repartition(6))
    assert straight.exceptAll(shuffled).count() == 0 and straight.count() == shuffled.count()


def test_progress_log_keeps_unclamped_values(spark):
    table = events(spark, ("t", None, 250, "over"), ("t", None, -4, "under"), ("t", None, 7, None), ("t", None, 9, ""))
    assert [r["progress"] for r in lifecycle.progress_log(table).orderBy("seq").collect()] == [250, -4]
    row = lifecycle.progress_fold(table).first()
    assert (row["progress"], row["log_entries"]) == (9, 2)


def test_latest_status_reports_the_last_error(spark):
    row = lifecycle.latest_status(events(spark, ("t", "failed", None, "a"), ("t", "failed", None, "b"), ("t", "retry", 20, None))).first()
    assert (row["status"], row["progress"], row["error_message"]) == ("retry", 20, "b")


def test_attempts_with_redelivery(spark):
    table = events(spark, *[("t", s, None, None) for s in ("processing", "retry", "retry", "processing", "retry", "retry")])
    rows = lifecycle.attempts(table.unionByName(table)).orderBy("seq").collect()
    assert [r["attempt"] for r in rows] == [1, 2, 3, 3, 4, 5]
    assert [r["retry_allowed"] for r in rows] == [None, True, True, None, True, False]
    assert rows[1]["retry_at"] - rows[1]["ts"] == dt.timedelta(seconds=60)


def test_review_progress(spark):
    files = spark.createDataFrame([("p", n, f"f{n}") for n in range(4)] + [("q", 9, None)], "pr_id string, file_id int, path string")
    rows = lifecycle.review_progress(files, [F.col("file_id")]).collect()
    of_p = sorted(r["progress"] for r in rows if r["pr_id"] == "p")
    assert of_p == [0, 10, 30, 30, 42, 55, 67, 85, 95, 100]
    messages = {r["message"] for r in rows}
    assert {"Analyzing file 2/4: f1", "Analyzing 4 files...", "Analyzing file 1/1: unknown"} <= messages


def test_stream_over_many_batches_equals_batch(spark, tmp_path):
    """Out-of-order events in several micro-batches, and a restart in between."""
    rng = random.Random(8)
    states = ["processing", "retry", "completed", "failed", None]
    table = events(spark, *[("hot" if rng.random() < 0.5 else f"t{rng.randrange(20)}", rng.choice(states), rng.choice([None, 30]), "m") for _ in range(600)])
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shuffled = table.orderBy(F.rand(3)).withColumn("slot", F.col("seq") % 3).drop("slot")
    parts = shuffled.randomSplit([1.0, 1.0, 1.0], seed=2)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream.start_task_fold(stream.read_task_events(spark, source), out, state).awaitTermination()
    streamed = stream.read_latest(spark, out)
    whole = lifecycle.fold_tasks(spark.read.schema(schemas.TASK_EVENTS).parquet(source)).select(*streamed.columns)
    assert streamed.count() == whole.count()
    assert streamed.exceptAll(whole).count() == 0


def test_stream_drops_redeliveries(spark, tmp_path):
    table = events(spark, *[("t", "retry", None, None)] * 5)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for _ in range(2):
        table.coalesce(1).write.mode("append").parquet(source)
        stream.start_deduplication(stream.read_task_events(spark, source), out, state).awaitTermination()
    assert spark.read.option("basePath", out).parquet(out).count() == 5


def test_redelivery_changes_nothing(spark):
    rows = spark.sql("SELECT 'r' AS task_id, timestamp'2024-01-01' AS ts, 1L AS seq, 'retry' AS state, 1 AS progress, 'm' AS message")
    many = rows.union(rows).union(rows).union(rows)
    assert lifecycle.fold_tasks(many).first()["retry_count"] == 1
    assert lifecycle.progress_fold(many).first()["log_entries"] == 1


def test_redelivery_changes_nothing_on_a_stream(spark, tmp_path):
    table = events(spark, ("t", "retry", None, None), ("t", None, 5, "m"))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for _ in range(2):
        table.union(table).coalesce(1).write.mode("append").parquet(source)
        stream.start_task_fold(stream.read_task_events(spark, source), out, state).awaitTermination()
    row = stream.read_latest(spark, out).first()
    assert (row["status"], row["retry_count"]) == ("retry", 1)
