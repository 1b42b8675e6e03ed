"""Appending events: validation, registry policy, idempotency, ids and causality, set at a time."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.jsonschema import violations
from ..functions.validate import last_key_wins, validate
from ..model import EVENT_COLUMNS, HOUR_MS, Config


def first_of_key(batch: DataFrame, key: str = "idempotency_key", order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(first row of each key, later rows with the first one's ordinal)."""
    w = Window.partitionBy(key).orderBy(order)
    ranked = batch.withColumn("_rank", F.row_number().over(w)).withColumn("first_ordinal", F.first(order).over(w))
    return ranked.where("_rank = 1").drop("_rank", "first_ordinal"), ranked.where("_rank > 1").drop("_rank")


def split_known(batch: DataFrame, log: DataFrame, key: str = "idempotency_key") -> tuple[DataFrame, DataFrame]:
    """(rows whose key the log lacks, duplicates with the original's id).

    By shuffles: two columns take little of a compressed log, so Spark's estimate would broadcast all its keys.
    """
    known = log.select(F.col(key), F.col("event_id").alias("original_event_id"))
    return batch.join(known.select(key).hint("merge"), key, "left_anti"), batch.join(known.hint("merge"), key)


def with_times(batch: DataFrame, now: int, config: Config) -> DataFrame:
    """emitted_at and both expiries; a row's own ttl_hours overrides the visible one."""
    ttl = F.coalesce(F.col("ttl_hours"), F.lit(config.ttl_hours)) if "ttl_hours" in batch.columns else F.lit(config.ttl_hours)
    return batch.withColumns({
        "emitted_at": F.lit(now).cast("bigint"),
        "expires_at": (F.lit(now) + ttl * HOUR_MS).cast("bigint"),
        "dedup_expires_at": F.lit(int(now + config.dedup_ttl_hours * HOUR_MS)).cast("bigint"),
    })


def assign_ids(batch: DataFrame, high_water: int, order: str = "ordinal", parts: int = 200) -> DataFrame:
    """Gapless ids after ``high_water`` in ascending order, without one task seeing all rows.

    Rows are cut into ranges by quantiles of the order column; ids start at the count of the ranges before.
    """
    bounds = batch.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<double>"), lambda b: b < F.col(order).cast("double"))) if bounds else F.lit(0)
    rows = batch.withColumn("_part", part)
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    starts, total = [], high_water
    for k in sorted(counts):
        starts += [F.lit(k), F.lit(total).cast("bigint")]
        total += counts[k]
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return rows.withColumn("event_id", rank + F.element_at(F.create_map(*starts), F.col("_part")) if starts else F.lit(None).cast("bigint")).drop("_part")


def chain_parents(rows: DataFrame, context: str = "correlation_id", order: str = "event_id", first_parent: Column | None = None) -> DataFrame:
    """parent_event_id of rows that name none: the event emitted before in their context.

    Rows without a context have no such event; they are spread over tasks as they are.
    """
    alone = F.when(F.col(context).isNull(), F.xxhash64(order))
    before = F.lag("event_id").over(Window.partitionBy(context, alone).orderBy(order))
    before = F.when(F.col(context).isNotNull(), F.coalesce(before, first_parent) if first_parent is not None else before)
    return rows.withColumn("parent_event_id", F.coalesce("parent_event_id", before) if "parent_event_id" in rows.columns else before)


def chosen(present: Column, value: Column, context: Column) -> Column:
    """A field given explicitly wins, null too; else the context's."""
    return F.when(present, value).otherwise(context)


def latest_schemas(registry: DataFrame) -> DataFrame:
    """The highest version of each type, one map-side aggregate."""
    columns = registry.columns
    return registry.groupBy("event_type").agg(F.max_by(F.struct(*columns), "version").alias("s")).select("s.*")


def apply_registry(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """Size policy and schema check of the latest registered version.

    Adds registry_schema_version, payload_cas_sha, cas_content, error_code (WB-008 in strict mode)
    and warnings. Under cas-auto an oversize payload becomes a pointer, and the schema is checked
    against the pointer. Each registered schema is compiled to one expression, so the registry,
    which people write by hand, is read on the driver.
    """
    last_key_wins(batch.sparkSession)
    latest = latest_schemas(registry)
    rows = batch.drop("registry_schema_version", "payload_cas_sha").join(latest.select("event_type", F.col("version").alias("registry_schema_version"), F.col("payload_max_bytes").alias("_cap"), F.col("payload_oversize").alias("_mode")), "event_type", "left")
    size = F.octet_length("payload")
    over = F.coalesce(size > F.col("_cap"), F.lit(False))
    to_cas = over & (F.col("_mode") == "cas-auto")
    sha = F.sha2("payload", 256)
    rows = rows.withColumns({
        "payload_cas_sha": F.when(to_cas, sha),
        "cas_content": F.when(to_cas, F.col("payload")),
        "error_code": F.when(over & (F.col("_mode") == "strict"), "WB-008"),
        "_warn": F.when(to_cas, F.concat(F.lit("payload offloaded to CAS: sha="), sha, F.lit(", original_size="), size.cast("string"))).when(over & ~F.col("_mode").isin("strict", "cas-auto"), F.concat(F.lit("WB-008 (warn): "), "event_type", F.lit(" payload size "), size.cast("string"), F.lit(" exceeds cap "), F.col("_cap").cast("string"))),
        "payload": F.when(to_cas, F.concat(F.lit('{"$cas":"'), sha, F.lit('"}'))).otherwise(F.col("payload")),
    })
    none = F.array().cast("array<string>")
    parsed = F.try_parse_json("payload")
    by_schema: dict[str, list[str]] = {}  # types that have the same schema are tested by one expression
    for r in latest.select("event_type", "json_schema").collect():
        by_schema.setdefault(r["json_schema"], []).append(r["event_type"])
    broken = None
    for text, types in by_schema.items():
        try:
            schema = json.loads(text)
        except (TypeError, ValueError):
            found = F.array(F.concat(F.lit("registry schema for "), "event_type", F.lit(" is unparseable")))
        else:
            said = F.when(parsed.isNull(), F.array(F.lit("payload is not valid JSON"))).otherwise(violations(schema, parsed))
            found = F.when(F.size(said) > 0, F.array(F.concat(F.lit("WB-009 (warn): "), "event_type", F.lit(" payload schema-mismatch: "), F.array_join(said, "; ")))).otherwise(none)
        mine = F.col("event_type").isin(*types)
        broken = F.when(mine, found) if broken is None else broken.when(mine, found)  # one flat CASE
    broken = none if broken is None else broken.otherwise(none)
    return rows.withColumn("warnings", F.concat(F.array_compact(F.array("_warn")), broken)).drop("_cap", "_mode", "_warn")


def emit_batch(batch: DataFrame, log: DataFrame, registry: DataFrame | None, now: int, high_water: int, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted events with ids, rejected rows with error_code).

    ``batch`` has ordinal and the fields of an event; rows are judged in the order validation,
    registry, idempotency, and of equal keys the first counts.
    """
    config = config or Config()
    for name in ("subdomain", "schema_version", "idempotency_key", "metadata", "session_id", "correlation_id", "producer_id", "origin_node_id"):
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(None).cast("string"))
    if "parent_event_id" not in batch.columns:
        batch = batch.withColumn("parent_event_id", F.lit(None).cast("bigint"))
    checked = validate(batch, config)
    rejected = checked.where("error_code is not null").select("ordinal", "error_code", "violation")
    good = checked.where("error_code is null").drop("error_code", "violation", "all_violations")
    good = good.withColumns({"subdomain": F.coalesce("subdomain", F.lit("")), "schema_version": F.coalesce("schema_version", F.lit("1.0.0")), "idempotency_key": F.coalesce("idempotency_key", F.concat(F.lit(f"{now}-"), F.col("ordinal").cast("string")))})
    if registry is not None:
        good = apply_registry(good, registry)
        rejected = rejected.unionByName(good.where("error_code is not null").select("ordinal", "error_code", F.lit("payload exceeds registry cap").alias("violation")))
        good = good.where("error_code is null")
    else:
        good = good.withColumns({"registry_schema_version": F.lit(None).cast("int"), "payload_cas_sha": F.lit(None).cast("string")})
    first, later = first_of_key(good)
    fresh, known = split_known(first, log)
    duplicate = known.select("ordinal").unionByName(later.select("ordinal"))
    rejected = rejected.unionByName(duplicate.select("ordinal", F.lit("WB-002").alias("error_code"), F.lit("duplicate idempotency_key").alias("violation")))
    accepted = chain_parents(assign_ids(with_times(fresh, now, config), high_water))
    return accepted.select("ordinal", *EVENT_COLUMNS), rejected
