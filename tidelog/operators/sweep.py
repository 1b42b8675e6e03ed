"""Expiry: the one-tier sweep and the sweep into monthly buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BusError

BATCH = 5000
BUCKET_BYTES = 10 << 30
BLOAT_BYTES = 1 << 30
BLOAT_ROWS = 1_000_000
#: Rows that one task may sort for a batch, and ranges (a power of two) in which the ids of a larger one are counted.
TOP_ROWS, RANGE_BITS = 100_000, 12


def eligible(now: int) -> Column:
    return F.col("dedup_expires_at") < now


def month_of(emitted_at: str = "emitted_at") -> Column:
    """The UTC month of an epoch-ms column (the session time zone is UTC)."""
    return F.date_format(F.timestamp_millis(F.col(emitted_at)), "yyyy-MM")


def sweep(live: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go)."""
    return live.where(~eligible(now)), live.where(eligible(now))


def archive_missing(swept: DataFrame, archive: DataFrame) -> DataFrame:
    """The swept rows that an archive does not have yet."""
    return swept.join(archive.select("event_id"), "event_id", "left_anti")


def oldest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least id.

    A small batch is a top-k. For a larger one the last id that goes is found by counts of ever
    narrower ranges of ids (some 4,096 counts a pass), so no task sorts or holds the batch.
    """
    if n <= TOP_ROWS:
        return rows.orderBy("event_id").limit(n)
    key = F.coalesce("event_id", F.lit(-(1 << 63)).cast("bigint"))  # a null id comes first
    low, high, total = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if total <= n:
        return rows
    bits, inside, before = max((high - low).bit_length() - RANGE_BITS, 0), F.lit(True), 0
    while True:
        counts = {r["k"]: r["n"] for r in rows.where(inside).groupBy(F.shiftright(key, bits).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for last in sorted(counts):
            if before + counts[last] >= n:
                break
            before += counts[last]
        if before + counts[last] == n or not bits:
            break
        inside, bits = F.shiftright(key, bits) == last, max(bits - RANGE_BITS, 0)
    place = F.shiftright(key, bits)
    if before + counts[last] == n:
        return rows.where(place <= last)
    return rows.where(place < last).unionByName(rows.where(place == last).limit(n - before))  # rows that share an id


def candidates(live: DataFrame, now: int, batch: int = BATCH) -> DataFrame:
    """The oldest eligible rows."""
    return oldest(live.where(eligible(now)), batch)


def next_suffix(bucket: str) -> str:
    """The bucket after one of a month: none, a, b, ... z."""
    tail = bucket[7:]
    if not tail:
        return bucket + "a"
    if len(tail) == 1 and "a" <= tail < "z":
        return bucket[:7] + chr(ord(tail) + 1)
    raise BusError("WB-001", f"no suffix left after {bucket}")


def choose_bucket(month: str, manifest: list[dict], max_bytes: int = BUCKET_BYTES) -> tuple[str, str | None]:
    """(bucket to write, bucket to seal): the month's last one unless it is sealed or full."""
    mine = sorted(r["bucket"] for r in manifest if r["bucket"].startswith(month))
    if not mine:
        return month, None
    last = next(r for r in manifest if r["bucket"] == mine[-1])
    if last["sealed_at"] is not None or (last["bytes"] or 0) >= max_bytes:
        return next_suffix(mine[-1]), None if last["sealed_at"] is not None else mine[-1]
    return mine[-1], None


def bucket_ranges(rows: DataFrame) -> DataFrame:
    """Least and greatest id and the count of each bucket."""
    return rows.groupBy("bucket").agg(F.min("event_id").alias("min_event_id"), F.max("event_id").alias("max_event_id"), F.count(F.lit(1)).alias("n"))


def bloat(rows: int, size: int, max_rows: int = BLOAT_ROWS, max_bytes: int = BLOAT_BYTES) -> str | None:
    """WB-012 if the live tier has outgrown a threshold."""
    return "WB-012" if rows > max_rows or size > max_bytes else None
