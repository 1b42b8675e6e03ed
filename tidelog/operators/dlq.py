"""Dead letters and delivery attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BusError


def list_dead_letters(letters: DataFrame, subscriptions: DataFrame, plugin: str | None = None, cursor_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, with the plugin's name (deregistered ones too)."""
    rows = letters if cursor_id is None else letters.where(F.col("cursor_id") == cursor_id)
    if plugin is not None:
        rows = rows.join(subscriptions.where(F.col("plugin") == plugin).select("subscription_id"), "subscription_id", "left_semi")
    named = rows.join(subscriptions.select("subscription_id", "plugin"), "subscription_id", "left")
    return named.orderBy(F.desc("dead_lettered_at"), F.desc("dl_id")).limit(limit)


def parse_payload(letters: DataFrame) -> DataFrame:
    """payload_ok tells whether the stored text parses; where it does not the row has WB-001."""
    ok = F.try_parse_json("payload").isNotNull()
    return letters.withColumns({"payload_ok": ok, "error_code": F.when(~ok, "WB-001")})


def request_replay(letters: DataFrame, dl_id: int, now: int) -> DataFrame:
    _must_exist(letters, dl_id)
    return letters.withColumn("replay_requested_at", F.when(F.col("dl_id") == dl_id, now).otherwise(F.col("replay_requested_at")))


def drop(letters: DataFrame, dl_id: int) -> DataFrame:
    _must_exist(letters, dl_id)
    return letters.where(F.col("dl_id") != dl_id)


def _must_exist(letters: DataFrame, dl_id: int) -> None:
    if letters.where(F.col("dl_id") == dl_id).isEmpty():
        raise BusError("WB-006", f"no dead letter {dl_id}")


def pending_replays(letters: DataFrame) -> DataFrame:
    return letters.where("replay_requested_at is not null").orderBy("dl_id")


def drain_replays(letters: DataFrame, handler: Callable[[dict], None]) -> DataFrame:
    """Tries pending letters one by one, oldest first: success removes, failure counts, unmarks and stops.

    The outcomes are applied at once: letters up to the last success are gone, so the plan does not
    grow with their number.
    """
    done = failed = error = None
    for row in pending_replays(letters).toLocalIterator():
        try:
            handler(row.asDict())
        except Exception as e:  # the handler is the user's
            failed, error = row["dl_id"], str(e)
            break
        done = row["dl_id"]
    if done is not None:
        letters = letters.where(F.col("replay_requested_at").isNull() | (F.col("dl_id") > done))
    if failed is not None:
        mine = F.col("dl_id") == failed
        letters = letters.withColumns({"attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")), "last_error": F.when(mine, error).otherwise(F.col("last_error")), "replay_requested_at": F.when(mine, F.lit(None)).otherwise(F.col("replay_requested_at")).cast("bigint")})
    return letters


def backoff_ms(attempts: Column, schedule: list[int]) -> Column:
    """The wait after so many attempts; the schedule's last step repeats."""
    return F.element_at(F.lit(schedule), F.least(attempts, F.lit(len(schedule))).cast("int"))


def exhausted(attempts: DataFrame, max_retries: int) -> DataFrame:
    """Deliveries that have used their first try and all retries."""
    return attempts.where(F.col("attempts") > max_retries)


def to_dead_letters(failed: DataFrame, events: DataFrame, cursors: DataFrame, now: int) -> DataFrame:
    """Denormalised letters of exhausted deliveries, without ids yet."""
    rows = failed.join(events.select("event_id", "event_type", "domain", "subdomain", "payload", "emitted_at"), "event_id").join(cursors.select("cursor_id", "subscription_id"), "cursor_id")
    return rows.select("cursor_id", "subscription_id", "event_id", "event_type", "domain", "subdomain", "payload", "emitted_at", "attempts", "last_error", F.lit(now).cast("bigint").alias("dead_lettered_at"), F.lit(None).cast("bigint").alias("replay_requested_at"))
