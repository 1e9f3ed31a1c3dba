"""Task lifecycle folds over event tables.

An event has task_id, seq, ts, state (null for a pure progress message),
progress, stage and message. Every fold is an aggregate that does not depend on
arrival order, so the same code runs on a batch and on a stream, and Spark
combines a hot task's events before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom import fixed_values as fv
from diffloom.functions import normalize as nz
from diffloom.functions.text import filled
from diffloom.operators.ordering import running_total

RETRY_DELAY_SECONDS = 60


def _order() -> Column:
    return F.struct("ts", "seq")


def _progress_set() -> Column:
    """The progress an event stores: starting resets it, completing fills it, failing keeps it."""
    return (
        F.when(F.col("state") == "completed", F.lit(100))
        .when(F.col("progress").isNotNull(), nz.clamp_progress(F.col("progress")))
        .when(F.col("state") == "processing", F.lit(0))
    )


def _times_seen(events: DataFrame, what: Column) -> Column:
    """How many different events of a task these are; a table has each event once already."""
    if not events.isStreaming:
        return F.count_if(what)
    return F.size(F.collect_set(F.when(what, F.struct("seq")))).cast("bigint")


def latest_status(events: DataFrame) -> DataFrame:
    """Current state, last reported progress and last error per task."""
    state, reported = F.col("state"), F.col("progress")
    return events.groupBy("task_id").agg(
        F.coalesce(F.max_by("state", F.when(state.isNotNull(), _order())), F.lit("pending")).alias("status"),
        F.max_by("progress", F.when(reported.isNotNull(), _order())).alias("progress"),
        F.max_by("message", F.when(state == "failed", _order())).alias("error_message"),
    )


def task_change() -> Column:
    """A stored task row as one value: the greatest is the newest, and of two at one time the one that ends the task."""
    return F.when(
        F.col("id").isNotNull() & F.col("updated_at").isNotNull(),
        F.struct("updated_at", F.coalesce(nz.task_is_completed(F.col("status")), F.lit(False)).alias("ended"), "status", "error_message"),
    )


def progress_report() -> Column:
    """An event that reports progress as one value: the greatest is the newest. Other events have none."""
    return F.when(
        F.col("task_id").isNotNull() & F.col("ts").isNotNull() & F.col("progress").isNotNull(),
        F.struct("ts", "seq", "progress", "stage"),
    )


def served_status(met: DataFrame) -> DataFrame:
    """What is served for each ``task_id``, from its newest ``task`` and ``report``; ``known`` says whether the task is stored."""
    task, report = F.col("task"), F.col("report")
    return met.select(
        "task_id", task.isNotNull().alias("known"), task["status"].alias("status"), task["error_message"].alias("error_message"),
        task["updated_at"].alias("updated_at"), report["progress"].alias("progress"), report["stage"].alias("stage"),
        report["ts"].alias("reported_at"),
    )


def live_status(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """The stored task rows beside the live progress of ``events``, one row for each task that either knows.

    ``tasks`` may hold many rows of a task (``id``, ``updated_at``, ``status``, ``error_message``): the newest counts. Rows without
    an id or a time say nothing. A task that never reported has no progress; progress of a task that is not stored has no status.
    """
    stored = tasks.groupBy(F.col("id").alias("task_id")).agg(F.max(task_change()).alias("task")).where("task IS NOT NULL")
    told = events.groupBy("task_id").agg(F.max(progress_report()).alias("report")).where("report IS NOT NULL")
    return served_status(stored.join(told, "task_id", "full_outer"))


def progress_fold(events: DataFrame) -> DataFrame:
    """Stored progress (clamped) and number of log entries per task."""
    if not events.isStreaming:
        events = without_redeliveries(events)
    value = _progress_set()
    logged = F.col("message").isNotNull() & (F.col("message") != "") & F.col("progress").isNotNull()
    return events.groupBy("task_id").agg(
        F.coalesce(F.max_by(value, F.when(value.isNotNull(), _order())), F.lit(0)).alias("progress"),
        _times_seen(events, logged).alias("log_entries"),
    )


def progress_log(events: DataFrame) -> DataFrame:
    """The progress log as rows, with the unclamped value. A list per task would have no bound."""
    return events.filter(
        F.col("message").isNotNull() & (F.col("message") != "") & F.col("progress").isNotNull()
    ).select("task_id", "ts", "seq", "progress", "message")


def fold_tasks(events: DataFrame, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """Task state after all events: status, retries, progress, times and error.

    Delivery is at least once: a table's redelivered events are folded first; a stream keeps the
    numbers of a task's retries in its state, so no redelivery counts however late it comes, and no late event is dropped.
    """
    if not events.isStreaming:
        events = without_redeliveries(events)
    state, value = F.col("state"), _progress_set()
    folded = events.groupBy("task_id").agg(
        F.coalesce(F.max_by("state", F.when(state.isNotNull(), _order())), F.lit("pending")).alias("_last"),
        _times_seen(events, state == "retry").alias("retry_count"),
        F.coalesce(F.max_by(value, F.when(value.isNotNull(), _order())), F.lit(0)).alias("progress"),
        F.max(F.when(state == "processing", F.col("ts"))).alias("started_at"),
        F.max(F.when(state.isin("completed", "failed"), F.col("ts"))).alias("completed_at"),
        F.max_by("message", F.when(state == "failed", _order())).alias("error_message"),
    )
    exhausted = (F.col("_last") == "retry") & (F.col("retry_count") > max_retries)
    return folded.select(
        "task_id",
        F.when(exhausted, "failed").otherwise(F.col("_last")).alias("status"),
        "retry_count", "progress", "started_at", "completed_at", "error_message",
    )


def review_progress(files: DataFrame, order: list[Column], key: str = "pr_id") -> DataFrame:
    """The progress reports of every review: the fixed stages, and one report per file in order.

    ``files`` has the key and ``path``. A file's progress follows from its place in the
    pull request, which is found without sorting a pull request in one task.
    """
    placed = running_total(files, [key], order, F.lit(1), "place", "files")
    stage, message = fv.FILE_STAGE
    by_file = placed.select(
        key,
        nz.stage_progress(F.col("place") - 1, F.col("files")).alias("progress"),
        F.lit(stage).alias("stage"),
        filled(message, place=F.col("place"), files=F.col("files"), path=F.coalesce("path", F.lit("unknown"))).alias("message"),
    )
    stages = F.array(
        *[
            F.struct(
                F.lit(progress).alias("progress"), F.lit(name).alias("stage"),
                filled(text, files=F.col("files")).alias("message"),
            )
            for progress, name, text in (*fv.STAGES_BEFORE_FILES, *fv.STAGES_AFTER_FILES)
        ]
    )
    sizes = files.groupBy(key).agg(F.count(F.lit(1)).alias("files"))
    return by_file.unionByName(sizes.select(key, F.explode(stages).alias("s")).select(key, "s.*"))


def without_redeliveries(events: DataFrame) -> DataFrame:
    """Delivery is at least once; (task_id, seq) names an event."""
    return events.dropDuplicates(["task_id", "seq"])


def attempts(events: DataFrame, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """Every event with its attempt number, and for retries whether and when they may run."""
    retry = F.coalesce(F.col("state") == "retry", F.lit(False))
    counted = running_total(
        without_redeliveries(events), ["task_id"], [F.col("ts"), F.col("seq")], retry.cast("int"), "_retries"
    )
    return counted.select(
        *events.columns,
        (F.col("_retries") + 1).alias("attempt"),
        F.when(retry, F.col("_retries") <= max_retries).alias("retry_allowed"),
        F.when(retry, F.timestamp_add("SECOND", F.lit(RETRY_DELAY_SECONDS), F.col("ts"))).alias("retry_at"),
    )
