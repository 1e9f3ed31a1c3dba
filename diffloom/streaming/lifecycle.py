"""Streaming task lifecycle: the batch folds over an event stream.

The folds run in update mode. Each micro-batch writes the tasks it changed to a
partition named after the batch, so a batch that is replayed after a failure
overwrites its own output, and readers take the newest row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffloom import schemas
from diffloom.operators import lifecycle
from diffloom.operators.quality import validate_requests
from diffloom.sources import landing

WATERMARK = "1 hour"


def read_task_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.TASK_EVENTS).parquet(path)


def read_webhooks(spark: SparkSession, path: str) -> DataFrame:
    return landing.webhook_events(spark.readStream.schema(schemas.WEBHOOK_JSON).json(path))


def deduplicated(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Drops redeliveries that arrive within the watermark; older state is let go."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["task_id", "seq"])


def _writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start_changes(folded: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  **trigger) -> StreamingQuery:
    return (
        folded.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(_writer(path))
        .start()
    )


def start_task_fold(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return start_changes(lifecycle.fold_tasks(events), path, checkpoint, **trigger)


def start_status(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return start_changes(lifecycle.latest_status(events), path, checkpoint, **trigger)


def start_progress_log(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return start_changes(lifecycle.progress_log(events), path, checkpoint, mode="append", **trigger)


def start_deduplication(events: DataFrame, path: str, checkpoint: str, watermark: str = WATERMARK,
                        **trigger) -> StreamingQuery:
    return start_changes(deduplicated(events, watermark), path, checkpoint, mode="append", **trigger)


def start_webhook_intake(webhooks: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Validated review requests to ``path/accepted``, refused ones to ``path/refused``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read once for both outputs
        try:
            accepted, refused = validate_requests(batch)
            accepted.write.mode("overwrite").parquet(f"{path}/accepted/batch_id={batch_id}")
            refused.write.mode("overwrite").parquet(f"{path}/refused/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        webhooks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_latest(spark: SparkSession, path: str, key: str = "task_id") -> DataFrame:
    """The newest row per key over all batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in (key, "batch_id")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("batch_id").cast("bigint")).alias("r"))
    return newest.select(key, "r.*")
