"""Content-addressed payloads: put, get, statistics and collection of unreferenced objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BusError

MAX_BYTES = 256 << 20
GRACE_DAYS = 7


def put(contents: DataFrame, store: DataFrame | None, now: int, max_bytes: int = MAX_BYTES, column: str = "content") -> tuple[DataFrame, DataFrame]:
    """(new objects, rejected contents): one object a hash, none that the store has."""
    rows = contents.where(F.col(column).isNotNull()).select(F.sha2(F.col(column), 256).alias("sha"), F.col(column).alias("content"), F.octet_length(column).cast("bigint").alias("size"), F.lit(now).cast("bigint").alias("mtime"))
    bad = rows.where(F.col("size") > max_bytes).select("sha", "size", F.lit("WB-008").alias("error_code"))
    new = rows.where(F.col("size") <= max_bytes).dropDuplicates(["sha"])
    return (new if store is None else new.join(store.select("sha"), "sha", "left_anti")), bad


def get(shas: DataFrame, store: DataFrame) -> DataFrame:
    return shas.join(store, "sha")


def existing(shas: DataFrame, store: DataFrame) -> DataFrame:
    return shas.join(store.select("sha"), "sha", "left_semi")


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def referenced(*tiers: DataFrame) -> DataFrame:
    """The distinct hashes that any tier's events point to."""
    out = None
    for t in tiers:
        part = t.where("payload_cas_sha is not null").select(F.col("payload_cas_sha").alias("sha"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def require_buckets(expected: set[str], readable: set[str], allow_missing: set[str] = frozenset()) -> None:
    """WB-010 unless every bucket of the manifest can be read or may be missing."""
    lost = sorted(expected - readable - set(allow_missing))
    if lost:
        raise BusError("WB-010", f"buckets {lost} are missing", missing=lost)


def collectable(store: DataFrame, live_shas: DataFrame, now: int, grace_days: int = GRACE_DAYS) -> DataFrame:
    """Unreferenced objects, with whether each is still in its grace time."""
    loose = store.join(live_shas, "sha", "left_anti")
    return loose.withColumn("in_grace", F.lit(now) - F.col("mtime") < grace_days * 86_400_000)


def gc_summary(store: DataFrame, live_shas: DataFrame, now: int, grace_days: int = GRACE_DAYS) -> DataFrame:
    """One row of counts, as a dry run and a real one report them."""
    loose = collectable(store, live_shas, now, grace_days).agg(F.count_if(~F.col("in_grace")).alias("deleted"), F.count_if("in_grace").alias("skipped_in_grace"), F.coalesce(F.sum(F.when(~F.col("in_grace"), F.col("size"))), F.lit(0)).cast("bigint").alias("bytes_freed"))
    return live_shas.agg(F.count(F.lit(1)).alias("live_shas")).crossJoin(store.agg(F.count(F.lit(1)).alias("considered"))).crossJoin(loose)
