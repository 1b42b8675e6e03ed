"""The driver's raw ``events`` table as bus events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import HOUR_MS


def bus_events(spark: SparkSession, sf_dir: str, parents: bool = False) -> DataFrame:
    """Ids from 1, dotted types (every fifth user's with a fourth segment), domains by user, both expiries, weekly buckets.

    ``parents`` links each event to its user's event before it, which takes a shuffle by user.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    area = F.when(F.col("event_type").isin("click", "view"), "ui").otherwise("acct")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    event_id = F.col("event_id") + 1
    rows = raw.select(
        event_id.alias("event_id"),
        F.concat(F.lit("bus."), area, F.lit("."), "event_type", F.when(F.col("user_id") % 5 == 0, ".sub").otherwise("")).alias("event_type"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("domain"),
        F.lit("").alias("subdomain"),
        F.col("props").alias("payload"),
        F.lit("1.0.0").alias("schema_version"),
        F.concat(F.lit("evt-"), event_id.cast("string")).alias("idempotency_key"),
        at.alias("emitted_at"),
        (at + 72 * HOUR_MS).alias("expires_at"),
        (at + 24 * HOUR_MS).alias("dedup_expires_at"),
        F.lit(None).cast("string").alias("metadata"),
        F.lit(None).cast("bigint").alias("parent_event_id"),
        F.concat(F.lit("s-"), (F.col("user_id") % 7).cast("string")).alias("session_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("correlation_id"),
        F.lit(None).cast("string").alias("producer_id"),
        F.lit(None).cast("string").alias("origin_node_id"),
        F.lit(None).cast("int").alias("registry_schema_version"),
        F.lit(None).cast("string").alias("payload_cas_sha"),
        F.concat(F.date_format("ts", "yyyy-MM"), F.when(week == 0, "").otherwise(F.char(F.lit(96) + week))).alias("bucket"),
    )
    if parents:
        rows = rows.withColumn("parent_event_id", F.lag("event_id").over(Window.partitionBy("correlation_id").orderBy("event_id")))
    return rows


#: The same view for DuckDB.
BUS_SQL = """
bus AS (
  SELECT event_id + 1 AS event_id,
         'bus.' || CASE WHEN event_type IN ('click', 'view') THEN 'ui' ELSE 'acct' END || '.' || event_type || CASE WHEN user_id % 5 = 0 THEN '.sub' ELSE '' END AS event_type,
         'svc-' || CAST(user_id % 4 AS VARCHAR) AS domain, '' AS subdomain, props AS payload,
         'evt-' || CAST(event_id + 1 AS VARCHAR) AS idempotency_key,
         CAST(epoch_us(ts) // 1000 AS BIGINT) AS emitted_at, CAST(epoch_us(ts) // 1000 AS BIGINT) + 259200000 AS expires_at, CAST(epoch_us(ts) // 1000 AS BIGINT) + 86400000 AS dedup_expires_at,
         's-' || CAST(user_id % 7 AS VARCHAR) AS session_id, 'user-' || CAST(user_id AS VARCHAR) AS correlation_id,
         lag(event_id + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_event_id,
         strftime(ts, '%Y-%m') || CASE WHEN (day(ts) - 1) // 7 = 0 THEN '' ELSE chr(CAST(96 + (day(ts) - 1) // 7 AS INTEGER)) END AS bucket
  FROM events)"""
