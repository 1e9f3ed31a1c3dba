"""Live status as a stream: changes of stored task rows meet the progress that workers report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffloom.operators import lifecycle
from diffloom.streaming.lifecycle import WATERMARK, start_changes

WINDOW = "1 minute"


def met_changes(tasks: DataFrame, events: DataFrame, task_watermark: str = WATERMARK, event_watermark: str = WATERMARK,
                window: str = WINDOW) -> DataFrame:
    """For each task and window of time, its last stored row and its last report; either may be missing.

    Both streams are first cut down to one row for each task and window, with a watermark of their own, and then meet in a full
    outer join. So a busy task costs a row a window, not a row for each pair, and state ends with its window. A window
    comes out when both streams have passed it; rows behind their stream's watermark are not seen.
    """
    stored = (
        tasks.withWatermark("updated_at", task_watermark)
        .groupBy(F.window("updated_at", window).alias("window"), F.col("id").alias("task_id"))
        .agg(F.max(lifecycle.task_change()).alias("task")).where("task IS NOT NULL")
    )
    # Every event moves the watermark, whether it reports progress or not: the condition is on the result.
    told = (
        events.withWatermark("ts", event_watermark)
        .groupBy(F.window("ts", window).alias("window"), "task_id")
        .agg(F.max(lifecycle.progress_report()).alias("report")).where("report IS NOT NULL")
    )
    return stored.join(told, ["window", "task_id"], "full_outer").select("task_id", "task", "report")


def start_live_status(tasks: DataFrame, events: DataFrame, path: str, checkpoint: str, task_watermark: str = WATERMARK,
                      event_watermark: str = WATERMARK, window: str = WINDOW, **trigger) -> StreamingQuery:
    """Writes what :func:`met_changes` finds, a folder for each micro-batch, so one that is replayed overwrites its own."""
    met = met_changes(tasks, events, task_watermark, event_watermark, window)
    return start_changes(met, path, checkpoint, mode="append", **trigger)


def read_live_status(spark: SparkSession, path: str) -> DataFrame:
    """:func:`diffloom.operators.lifecycle.live_status` of all windows that came out."""
    rows = spark.read.option("basePath", path).parquet(path)
    return lifecycle.served_status(rows.groupBy("task_id").agg(F.max("task").alias("task"), F.max("report").alias("report")))
