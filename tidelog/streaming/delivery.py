"""Streams over appended event files: subscriptions, fan-out, dedup, windows, and retries with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.filters import matches
from ..model import EVENT
from ..operators.fanout import fan_out, inline_or_pointer


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files appended to a live tier, as they come; the cap is the backpressure."""
    reader = spark.readStream.schema(EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("event_time", F.timestamp_millis(F.col("emitted_at")))


def deduplicated(events: DataFrame, window: str = "24 hours") -> DataFrame:
    """The first event of a key within the dedup window; state is dropped behind the watermark."""
    return events.withWatermark("event_time", window).dropDuplicatesWithinWatermark(["idempotency_key"])


def subscription(events: DataFrame, filter_text: str, now: int | None = None) -> DataFrame:
    """What a subscriber's filter takes, without the expired if ``now`` is given."""
    rows = events.where(matches(filter_text))
    return rows if now is None else rows.where(F.col("expires_at") > now)


def pushed(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Notices to all subscribers: a stream-static equi-join, with small events inline."""
    return inline_or_pointer(fan_out(events, subscribers)).select("cursor_id", "event_id", "event")


def counts_per_window(events: DataFrame, size: str = "1 hour", late: str = "24 hours") -> DataFrame:
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "24 hours") -> DataFrame:
    return events.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap), "correlation_id").agg(F.count(F.lit(1)).alias("n"))


class Retries(StatefulProcessor):
    """Delivers each cursor's events in order, tries each up to 1 + max_retries times, and dead-letters the rest.

    The attempts of the event in work are state, so a restarted query resumes the count. Waiting is
    left to the caller: without timers an availableNow run ends.
    """

    def __init__(self, handler: Callable[[dict], Any], max_retries: int):
        self.handler, self.max_retries = handler, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getMapState("attempts", "event_id bigint", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values("event_id")
        out = []
        for row in batch.to_dict("records"):
            at = (int(row["event_id"]),)
            tries = self.attempts.getValue(at)[0] if self.attempts.containsKey(at) else 0
            status, error = "dead_letter", None
            while tries <= self.max_retries:
                tries += 1
                self.attempts.updateValue(at, (tries,))
                try:
                    self.handler(row)
                    status, error = "delivered", None
                    break
                except Exception as e:  # the handler is the user's
                    error = str(e)
            self.attempts.removeKey(at)
            out.append((key[0], row["event_id"], status, tries, error))
        yield pd.DataFrame(out, columns=["cursor_id", "event_id", "status", "attempts", "last_error"])

    def close(self) -> None:
        pass


def delivered(notices: DataFrame, handler: Callable[[dict], Any], max_retries: int = 3) -> DataFrame:
    """(cursor_id, event_id, status, attempts, last_error) of every notice; parallel over cursors, serial in each."""
    return notices.groupBy("cursor_id").transformWithStateInPandas(Retries(handler, max_retries), "cursor_id string, event_id bigint, status string, attempts int, last_error string", "append", "none")


def start(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Runs a stream into ``sink``; the checkpoint's commit after each batch is the acknowledgement (at least once)."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def ndjson(rows: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
