"""Subscriptions and cursors as change rows that fold to their latest state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CURSOR, SUBSCRIPTION, BusError


def fold(changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last change of each key."""
    columns = [c for c in changes.columns if c != seq]
    return changes.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("s")).select("s.*")


def register(spark: SparkSession, plugin: str, filter_text: str, now: int, high_water: int, role: str = "subscriber", cursor_init: str = "latest", ids: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A subscription row and, for subscribers, its cursor row; ``latest`` starts at the highest id ever given."""
    if role not in ("provider", "subscriber") or cursor_init not in ("latest", "oldest"):
        raise BusError("WB-001", "unknown role or cursor_init")
    sub, cur = ids or (str(uuid.uuid4()), str(uuid.uuid4()))
    subscription = spark.createDataFrame([(sub, plugin, role, filter_text, None, now, None, 60_000)], SUBSCRIPTION)
    cursor = [(cur, sub, high_water if cursor_init == "latest" else 0, None, now, None, None, None)] if role == "subscriber" else []
    return subscription, spark.createDataFrame(cursor, CURSOR)


def deregister(subscriptions: DataFrame, cursors: DataFrame, subscription_id: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Soft-deletes a subscription and its cursors."""
    if subscriptions.where((F.col("subscription_id") == subscription_id) & F.col("deregistered_at").isNull()).isEmpty():
        raise BusError("WB-006", f"no subscription {subscription_id}")
    stamp = F.when((F.col("subscription_id") == subscription_id) & F.col("deregistered_at").isNull(), now).otherwise(F.col("deregistered_at"))
    return subscriptions.withColumn("deregistered_at", stamp), cursors.withColumn("deregistered_at", stamp)


def active(rows: DataFrame, role: str | None = None) -> DataFrame:
    rows = rows.where("deregistered_at is null")
    return rows if role is None else rows.where(F.col("role") == role)


def with_cursors(subscriptions: DataFrame, cursors: DataFrame) -> DataFrame:
    """Active subscriptions joined with their active cursors."""
    right = active(cursors).select("cursor_id", "subscription_id", "last_event_id", "acked_at", F.col("created_at").alias("cursor_created_at"))
    return active(subscriptions).join(right, "subscription_id")


def resume(subscriptions: DataFrame, cursors: DataFrame, plugin: str, filter_text: str) -> DataFrame:
    """The newest active subscription and cursor of a plugin and filter; empty if there is none."""
    mine = with_cursors(subscriptions, cursors).where((F.col("plugin") == plugin) & (F.col("event_type_filter") == filter_text))
    return mine.orderBy(F.desc("registered_at"), F.desc("cursor_created_at"), "cursor_id").limit(1)


def resume_only(subscriptions: DataFrame, cursors: DataFrame, plugin: str, filter_text: str):
    """As ``resume``, but more than one candidate is an error; None if there is none."""
    mine = with_cursors(subscriptions, cursors).where((F.col("plugin") == plugin) & (F.col("event_type_filter") == filter_text)).limit(2).collect()
    if len(mine) > 1:
        raise BusError("WB-001", "several cursors match")
    return mine[0] if mine else None


def register_or_resume(subscriptions: DataFrame, cursors: DataFrame, plugin: str, filter_text: str, now: int, high_water: int, cursor_init: str = "latest", strict: bool = False) -> tuple[dict, tuple[DataFrame, DataFrame] | None]:
    """(subscription_id, cursor_id and last_event_id to go on from, the new rows if it had to register).

    An active cursor of the plugin and filter is taken up, the newest of several; with ``strict``
    several are an error.
    """
    found = resume_only(subscriptions, cursors, plugin, filter_text) if strict else next(iter(resume(subscriptions, cursors, plugin, filter_text).collect()), None)
    keys = ("subscription_id", "cursor_id", "last_event_id")
    if found is not None:
        return {k: found[k] for k in keys}, None
    made = register(subscriptions.sparkSession, plugin, filter_text, now, high_water, cursor_init=cursor_init)
    row = made[1].first()
    return {k: row[k] for k in keys}, made


def list_subscriptions(subscriptions: DataFrame, role: str | None = None, include_deregistered: bool = False) -> DataFrame:
    rows = subscriptions if include_deregistered else active(subscriptions)
    rows = rows if role is None else rows.where(F.col("role") == role)
    return rows.orderBy(F.desc("registered_at"))
