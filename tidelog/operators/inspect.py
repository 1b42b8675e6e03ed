"""Status, lag, traces and the read-only event listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import scratch

API_COLUMNS = ["event_id", "event_type", "domain", "subdomain", "payload", "emitted_at", "expires_at", "parent_event_id", "session_id", "correlation_id", "producer_id", "payload_cas_sha"]


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.min("event_id").alias("oldest_event_id"), F.max("event_id").alias("newest_event_id"))


def counts_by(events: DataFrame, column: str, top: int | None = None) -> DataFrame:
    rows = events.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return rows if top is None else rows.limit(top)


def counts_map(events: DataFrame, column: str = "event_type") -> DataFrame:
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias("by_type"))


def per_hour(events: DataFrame, since: int, until: int) -> DataFrame:
    hour = (F.floor(F.col("emitted_at") / 3_600_000) * 3_600_000).cast("bigint")
    rows = events.where((F.col("emitted_at") >= since) & (F.col("emitted_at") < until))
    return rows.groupBy(hour.alias("hour_ms")).agg(F.count(F.lit(1)).alias("n"))


def ends(events: DataFrame) -> DataFrame:
    """The oldest and the newest event, one row each."""
    low = events.orderBy("event_id").limit(1).select(F.lit("oldest").alias("which"), "event_id", "event_type", "emitted_at")
    return low.unionAll(events.orderBy(F.desc("event_id")).limit(1).select(F.lit("newest"), "event_id", "event_type", "emitted_at"))


def subscriber_lag(joined: DataFrame, events: DataFrame) -> DataFrame:
    """newest - last of each subscriber, neither clamped nor filtered."""
    newest = events.agg(F.max("event_id").alias("_newest"))
    return joined.crossJoin(F.broadcast(newest)).withColumn("lag", F.col("_newest") - F.col("last_event_id")).drop("_newest")


def cursor_lag(cursors: DataFrame, events: DataFrame, letters: DataFrame, now: int, step: int = 1 << 16) -> DataFrame:
    """Clamped lag, age of the oldest unseen visible event and dead letters of each cursor.

    The age needs the earliest emission after each cursor. Ids are cut into blocks: all blocks are
    reduced to a row each, and only blocks with a cursor in them are looked at row by row.
    """
    block = lambda c: F.floor(F.col(c) / step)
    shown = F.when(F.col("expires_at") > now, F.col("emitted_at"))
    rows = events.select("event_id", shown.alias("first"), block("event_id").alias("block"))
    marks = cursors.select(F.col("last_event_id").alias("event_id")).distinct().withColumn("block", block("event_id"))
    inside = rows.join(marks.select("block").distinct(), "block", "left_semi").withColumn("mark", F.lit(0))
    both = inside.unionByName(marks.withColumns({"first": F.lit(None).cast("bigint"), "mark": F.lit(1)}))
    later = Window.partitionBy("block").orderBy(F.desc("event_id"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.min("first").over(later)).where("mark = 1").select("event_id", "block", "near")
    reduced = rows.groupBy("block").agg(F.min("first").alias("f"), F.max("event_id").alias("top"))
    blocks = reduced.unionByName(marks.select("block", F.lit(None).cast("bigint").alias("f"), F.lit(None).cast("bigint").alias("top"))).groupBy("block").agg(F.min("f").alias("f"), F.max("top").alias("top"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65,536 ids
    far = blocks.select("block", F.min("f").over(above).alias("far"), F.max("top").over(Window.partitionBy(F.lit(0))).alias("newest"))
    oldest = near.join(far, "block").select(F.col("event_id").alias("last_event_id"), F.least("near", "far").alias("oldest"), "newest")
    dead = letters.groupBy("cursor_id").agg(F.count(F.lit(1)).alias("_dead"))
    rows = cursors.join(oldest, "last_event_id", "left").join(dead, "cursor_id", "left")
    return rows.select("cursor_id", F.greatest(F.coalesce("newest", F.lit(0)) - F.col("last_event_id"), F.lit(0)).alias("cursor_lag"), (F.lit(now) - F.col("oldest")).alias("oldest_unacked_age_ms"), F.coalesce("_dead", F.lit(0)).alias("dlq_count"))


def api_events(events: DataFrame, since: int = 0, limit: int = 100, **equal: str) -> DataFrame:
    """The listing's columns, equality filters and a limit within 1 and 1000."""
    rows = events.where(F.col("event_id") > since)
    for k in ("event_type", "domain", "subdomain", "correlation_id", "session_id"):
        if equal.get(k) is not None:
            rows = rows.where(F.col(k) == equal[k])
    return rows.select(*API_COLUMNS).orderBy("event_id").limit(max(1, min(1000, limit)))


def latest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("event_id")).limit(n)


def trace(events: DataFrame, correlation_id: str) -> DataFrame:
    """All events of a correlation, by id."""
    return events.where(F.col("correlation_id") == correlation_id).orderBy("event_id")


def trace_tree(events: DataFrame, correlation_id: str) -> DataFrame:
    """event_id, parent and depth of a correlation's tree; the roots' parents lie outside it.

    Every event points to an ancestor at a known distance; each round lets open ones jump to their
    ancestor's ancestor and is written to shared storage, so about log2(depth) joins serve any
    depth. Events that lead to no root (a circle of parents) are left out. Event ids are unique.
    """
    spark = events.sparkSession
    folder = scratch(spark, "trace")

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = staged(events.where(F.col("correlation_id") == correlation_id).select("event_id", "parent_event_id"), "rows")
    inside = rows.select(F.col("event_id").alias("up"))
    child = rows.where("parent_event_id is not null").join(inside, F.col("parent_event_id") == F.col("up"), "left")
    root = rows.where("parent_event_id is null").withColumn("up", F.lit(None).cast("bigint"))
    state = staged(root.unionByName(child).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)), "0")
    for k in range(1, rows.count().bit_length() + 1):  # a way to a root has fewer steps than there are rows
        open_ = state.where("up is not null")
        if open_.isEmpty():
            break
        ancestors = state.select(F.col("event_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        jumped = open_.join(ancestors, "up").select("event_id", "parent_event_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = staged(state.where("up is null").unionByName(jumped), str(k))
    return state.where("up is null").select("event_id", "parent_event_id", "depth")
