"""Retries on the event stream: each comes due a while after its event, in order, counted once, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from diffloom import fixed_values as fv
from diffloom.operators.lifecycle import RETRY_DELAY_SECONDS
from diffloom.streaming.lifecycle import WATERMARK

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting and settled retries of a task by number, the retries counted, and the newest event; times in microseconds.
STATE = "waiting array<bigint>, waiting_at array<bigint>, settled array<bigint>, settled_at array<bigint>, counted bigint, newest bigint"
MICROS = 1_000_000


class _Retries(StatefulProcessor):
    """One task's retries.

    A retry waits until the watermark passes its due time. By then no earlier event can come in any more, so its place
    among the task's retries is final: it is counted, and comes out as due or, beyond the permitted number, as
    failed. Its number is remembered until the watermark is ``remember`` past its event, so that a
    redelivery is known for one; later copies are behind the watermark and come out as late, as any event does. A
    task without events for ``lifetime`` is forgotten whole.
    """

    def __init__(self, max_retries: int, remember: int, lifetime: int):
        self.max_retries, self.remember, self.lifetime = max_retries, remember, lifetime
        self.delay = RETRY_DELAY_SECONDS * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retries", STATE)

    def _loaded(self) -> tuple[dict, dict, int, int]:
        if not self.state.exists():
            return {}, {}, 0, 0
        waiting, waiting_at, settled, settled_at, counted, newest = self.state.get()
        return dict(zip(waiting, waiting_at)), dict(zip(settled, settled_at)), counted, newest

    def _stored(self, waiting: dict, settled: dict, counted: int, newest: int, mark: int) -> None:
        """Writes the state and asks to be woken when the next thing happens to it."""
        times = [min(waiting.values()) + self.delay] if waiting else []
        times += [min(settled.values()) + self.remember] if settled else []
        wake = min(times, default=newest + self.lifetime)
        if not times and wake <= mark:
            self.state.clear()
            return
        self.state.update((list(waiting), list(waiting.values()), list(settled), list(settled.values()), counted, newest))
        self.handle.registerTimer(-(-wake // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        waiting, settled, counted, newest = self._loaded()
        late = []
        for batch in rows:
            for seq, at in zip(batch["seq"].tolist(), batch["at"].tolist()):
                if seq in waiting or seq in settled:
                    continue
                if at < mark:
                    late.append((key[0], seq, at, None, None, "late"))
                else:
                    waiting[seq] = at
                    newest = max(newest, at)
        if waiting or settled or counted:
            self._stored(waiting, settled, counted, newest, mark)
        if late:
            yield pd.DataFrame(list(dict.fromkeys(late)), columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, settled, counted, newest = self._loaded()
        out = []
        for at, seq in sorted((at, seq) for seq, at in waiting.items() if at + self.delay <= mark):
            counted += 1
            del waiting[seq]
            settled[seq] = at
            allowed = counted <= self.max_retries
            out.append((key[0], seq, at, counted + 1, allowed, "due" if allowed else "failed"))
        settled = {seq: at for seq, at in settled.items() if at + self.remember > mark}
        if waiting or settled or counted:
            self._stored(waiting, settled, counted, newest, mark)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["task_id", "seq", "at", "attempt", "retry_allowed", "kind"]


def _micros(spark, interval: str) -> int:
    return int(spark.range(1).select(F.expr(
        f"unix_micros(timestamp'2000-01-01' + interval {interval}) - unix_micros(timestamp'2000-01-01')")).first()[0])


def retry_rows(events: DataFrame, watermark: str = WATERMARK, remember: str = "2 hours", lifetime: str = "30 days",
               max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """A stream of ``task_id``, ``seq``, ``at``, ``attempt``, ``retry_allowed`` and ``kind``: due, failed or late."""
    spark = events.sparkSession
    # This operator needs state on disk, whatever the session was started with.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    task_type = events.schema["task_id"].dataType.simpleString()
    # Every event moves the watermark, and retries go on. Their time goes on as a number: rows behind the watermark
    # must reach the processor, which sets them aside, and not be dropped on the way.
    timed = events.withWatermark("ts", watermark)
    # One condition on ts as a whole: a part without ts would be moved before the watermark, and only retries would move it.
    asked = timed.where("CASE WHEN ts IS NULL THEN false ELSE state = 'retry' AND task_id IS NOT NULL AND seq IS NOT NULL END").select(
        "task_id", "seq", F.unix_micros("ts").alias("at"))
    return asked.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_Retries(max_retries, _micros(spark, remember), _micros(spark, lifetime)),
        outputStructType=f"task_id {task_type}, seq bigint, at bigint, attempt bigint, retry_allowed boolean, kind string",
        outputMode="append", timeMode="eventTime")


def start_retries(events: DataFrame, path: str, checkpoint: str, watermark: str = WATERMARK, remember: str = "2 hours",
                  lifetime: str = "30 days", max_retries: int = fv.MAX_RETRIES, **trigger) -> StreamingQuery:
    """Retries as they come due to ``path/due``, and events behind the watermark to ``path/late``.

    Each micro-batch writes folders named after it, so a batch that is replayed overwrites its own output. Delivery
    may be at least once: a retry counts once. Results equal those of :func:`diffloom.operators.lifecycle.attempts` over
    all events that were not late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read once for both outputs
        try:
            when = F.timestamp_micros("at")
            due = batch.where("kind <> 'late'").select(
                "task_id", "seq", "attempt", "retry_allowed", F.timestamp_add("SECOND", F.lit(RETRY_DELAY_SECONDS), when).alias("retry_at"))
            due.write.mode("overwrite").parquet(f"{path}/due/batch_id={batch_id}")
            batch.where("kind = 'late'").select("task_id", "seq", when.alias("ts")).write.mode("overwrite").parquet(
                f"{path}/late/batch_id={batch_id}")
        finally:
            batch.unpersist()

    rows = retry_rows(events, watermark, remember, lifetime, max_retries)
    return (
        rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    )
