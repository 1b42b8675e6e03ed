"""Fan-out of events to subscribers as an equi-join, and delivery shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.filters import event_keys, parsed
from ..model import EVENT_COLUMNS
from .poll import equal_to

INLINE_BYTES = 16_384
QUEUE = 256
#: Parts that the events of one key are dealt to.
SALTS = 16


def fan_out(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row an event and subscriber whose filter takes it and whose cursor is before it.

    ``subscribers`` has cursor_id, event_type_filter and last_event_id. An event has three keys and
    a filter one, so this is a join on (kind, key), not on every pair. Spark broadcasts the
    subscribers if they are small and shuffles otherwise; then the events of a key, which for
    ``*`` are all of them, are dealt to ``SALTS`` tasks, to each of which go the key's filters.
    """
    subs = subscribers.select("cursor_id", "last_event_id", parsed(F.col("event_type_filter")).alias("_f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")).select("cursor_id", "last_event_id", F.col("_f.kind").alias("_kind"), F.col("_f.key").alias("_key"), F.col("_f.domain").alias("_domain"), "_salt")
    keyed = events.withColumn("_k", F.explode(event_keys(F.col("event_type")))).withColumns({"_kind": F.col("_k.kind"), "_key": F.col("_k.key"), "_salt": F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")}).drop("_k")
    joined = keyed.join(subs, ["_kind", "_key", "_salt"]).drop("_salt")
    wanted = (F.col("event_id") > F.col("last_event_id")) & (F.col("_domain").isNull() | (F.col("_domain") == F.col("domain")))
    return joined.where(wanted).drop("_kind", "_key", "_domain", "last_event_id")


def push_matches(where: dict | None) -> Column:
    """A push subscriber's filter: equality on event_type, domain and subdomain; none takes everything."""
    return equal_to(where)


def inline_or_pointer(rows: DataFrame, columns: list[str] = EVENT_COLUMNS, limit: int = INLINE_BYTES) -> DataFrame:
    """Adds ``event``: the row as JSON if it takes at most ``limit`` bytes, else null, to be looked up by id."""
    body = F.to_json(F.struct(*[c for c in columns if c in rows.columns]))
    return rows.withColumn("event", F.when(F.octet_length(body) <= limit, body))


def resolve_pointers(notices: DataFrame, events: DataFrame) -> DataFrame:
    """Notices without a body get the event's row by id."""
    return notices.join(events, "event_id", "left")


def bounded_queue(rows: DataFrame, size: int = QUEUE) -> DataFrame:
    """The newest ``size`` rows of each subscriber, as a queue that drops its oldest keeps them."""
    newest = Window.partitionBy("cursor_id").orderBy(F.desc("event_id"))
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= size).drop("_rank")


def queue_counters(rows: DataFrame, size: int = QUEUE) -> DataFrame:
    """Per subscriber: rows offered, queued and dropped."""
    n = rows.groupBy("cursor_id").agg(F.count(F.lit(1)).alias("offered"))
    return n.withColumns({"queued": F.least("offered", F.lit(size)), "dropped": F.greatest(F.col("offered") - size, F.lit(0))})


def degrade_points(depths: DataFrame, size: int = QUEUE, share: float = 0.75, hold_ms: int = 30_000) -> DataFrame:
    """When each subscriber falls back to polling: its queue has been at least ``share`` full for ``hold_ms``.

    ``depths`` has cursor_id, at (ms) and depth. A run of full samples starts after the last sample below the mark.
    """
    order = Window.partitionBy("cursor_id").orderBy("at")
    full = F.col("depth") >= share * size
    runs = depths.withColumn("_run", F.sum(F.when(full, 0).otherwise(1)).over(order)).where(full)
    since = F.min("at").over(Window.partitionBy("cursor_id", "_run"))
    return runs.withColumn("_held", F.col("at") - since).where(F.col("_held") >= hold_ms).groupBy("cursor_id").agg(F.min("at").alias("degraded_at"))
