"""Reading with cursors: live polls, tiered polls over live and warm rows, acknowledgement and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.filters import matches
from ..model import BusError

BATCH = 100


def visible(now: int) -> Column:
    return F.col("expires_at") > now


def poll(events: DataFrame, last_event_id: int, filter_text: str, now: int, batch: int = BATCH) -> DataFrame:
    """The next visible events of a cursor, by id. All tests are pushed to the scan; the limit is a top-k."""
    rows = events.where((F.col("event_id") > last_event_id) & visible(now) & matches(filter_text))
    return rows.orderBy("event_id").limit(batch)


def is_behind(last_event_id: Column | int, oldest: Column) -> Column:
    """Whether rows between a cursor and the oldest kept row are gone."""
    last = F.lit(last_event_id) if isinstance(last_event_id, int) else last_event_id
    return F.coalesce(last < oldest - 1, F.lit(False))


def check_cursor(events: DataFrame, last_event_id: int) -> None:
    """WB-003 if the cursor is behind the oldest row, visible or not."""
    oldest = events.agg(F.min("event_id")).first()[0]
    if oldest is not None and last_event_id < oldest - 1:
        raise BusError("WB-003", f"cursor at {last_event_id}, oldest event {oldest}", oldest_event_id=oldest)


def cursor_states(cursors: DataFrame, events: DataFrame) -> DataFrame:
    """Every cursor with the log's ends and whether it is behind; the ends are one row."""
    ends = events.agg(F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"))
    return cursors.crossJoin(F.broadcast(ends)).withColumn("behind", is_behind(F.col("last_event_id"), F.col("oldest")))


def equal_to(where: dict | None) -> Column:
    """Conjunctive equality on event_type, domain and subdomain."""
    test = F.lit(True)
    for k in ("event_type", "domain", "subdomain"):
        if where and where.get(k) is not None:
            test = test & (F.col(k) == where[k])
    return test


def covering(manifest: DataFrame, low: int, high: int) -> DataFrame:
    """Buckets whose ids may overlap [low, high]; unsealed ones are open upwards, empty ones are skipped."""
    top = F.when(F.col("sealed_at").isNull(), F.lit((1 << 63) - 1)).otherwise(F.col("max_event_id"))
    return manifest.where(F.col("min_event_id").isNotNull() & (top >= low) & (F.col("min_event_id") <= high))


def prefer_live(live: DataFrame, warm: DataFrame) -> DataFrame:
    """The union of both tiers with one row an id, the live one if there are two."""
    both = live.withColumn("_tier", F.lit(1)).unionByName(warm.withColumn("_tier", F.lit(0)), allowMissingColumns=True)
    first = Window.partitionBy("event_id").orderBy(F.desc("_tier"))
    return both.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "_tier")


def poll_tiered(live: DataFrame, warm: DataFrame, last_event_id: int, where: dict | None = None, batch: int = BATCH) -> DataFrame:
    """Events after a cursor from both tiers: ids are unique in a tier, so each gives its own first ``batch`` rows to the dedupe."""
    test = (F.col("event_id") > last_event_id) & equal_to(where)
    heads = [t.where(test).orderBy("event_id").limit(batch) for t in (live, warm)]
    return prefer_live(*heads).orderBy("event_id").limit(batch)


def poll_many(events: DataFrame, cursors: DataFrame, now: int, batch: int = BATCH) -> DataFrame:
    """The next batch of every cursor at once (fan-out, then a rank within the cursor)."""
    from .fanout import fan_out

    hits = fan_out(events.where(visible(now)), cursors)
    order = Window.partitionBy("cursor_id").orderBy("event_id")
    return hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= batch).drop("_rank")


def cursor_row(cursors: DataFrame, cursor_id: str) -> dict:
    """An active cursor; WB-006 if it is unknown or deregistered."""
    found = cursors.where((F.col("cursor_id") == cursor_id) & F.col("deregistered_at").isNull()).head(1)
    if not found:
        raise BusError("WB-006", f"no active cursor {cursor_id}", cursor_id=cursor_id)
    return found[0].asDict()


def poll_cursor(events: DataFrame, cursors: DataFrame, subscriptions: DataFrame, cursor_id: str, now: int, batch: int = BATCH) -> DataFrame:
    """The next events of a cursor by its subscription's filter; WB-006 without either, WB-003 behind the oldest row."""
    cursor = cursor_row(cursors, cursor_id)
    check_cursor(events, cursor["last_event_id"])
    found = subscriptions.where((F.col("subscription_id") == cursor["subscription_id"]) & F.col("deregistered_at").isNull()).head(1)
    if not found:
        raise BusError("WB-006", f"no active subscription {cursor['subscription_id']}", cursor_id=cursor_id)
    return poll(events, cursor["last_event_id"], found[0]["event_type_filter"], now, batch)


def ack(cursors: DataFrame, cursor_id: str, last_event_id: int, now: int) -> DataFrame:
    """Sets an active cursor to any id, backwards too."""
    cursor_row(cursors, cursor_id)
    mine = F.col("cursor_id") == cursor_id
    return cursors.withColumns({"last_event_id": F.when(mine, last_event_id).otherwise(F.col("last_event_id")), "acked_at": F.when(mine, now).otherwise(F.col("acked_at"))})


def ack_forward(cursors: DataFrame, acks: DataFrame, now: int) -> DataFrame:
    """Many acknowledgements (cursor_id, event_id), each of which only moves its cursor forwards."""
    top = acks.groupBy("cursor_id").agg(F.max("event_id").alias("_to"))
    joined = cursors.join(top, "cursor_id", "left")
    return joined.withColumns({"acked_at": F.when(F.col("_to").isNotNull(), now).otherwise(F.col("acked_at")), "last_event_id": F.greatest("last_event_id", "_to")}).drop("_to")


def replay(cursors: DataFrame, events: DataFrame, cursor_id: str, from_event_id: int) -> DataFrame:
    """Moves a cursor so that ``from_event_id`` comes next; acked_at stays."""
    oldest = events.agg(F.min("event_id")).first()[0]
    if oldest is not None and from_event_id < oldest:
        raise BusError("WB-003", f"event {from_event_id} is gone, oldest is {oldest}", oldest_event_id=oldest)
    if cursors.where(F.col("cursor_id") == cursor_id).isEmpty():
        raise BusError("WB-006", f"no cursor {cursor_id}")
    return cursors.withColumn("last_event_id", F.when(F.col("cursor_id") == cursor_id, from_event_id - 1).otherwise(F.col("last_event_id")))


def gaps(events: DataFrame, step: int = 1 << 16) -> DataFrame:
    """Missing id ranges (after, before). Ids are compared within blocks, and blocks by their ends, so no task sorts the log."""
    block = F.floor(F.col("event_id") / step)
    inner = Window.partitionBy("block").orderBy("event_id")
    rows = events.select("event_id", block.alias("block"))
    inside = rows.select(F.lag("event_id").over(inner).alias("after"), F.col("event_id").alias("before")).where("after is not null")
    ends = rows.groupBy("block").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    outer = Window.partitionBy(F.lit(0)).orderBy("block")  # a row for each 65,536 ids
    across = ends.select(F.lag("hi").over(outer).alias("after"), F.col("lo").alias("before")).where("after is not null")
    return inside.unionByName(across).where("before - after > 1")
