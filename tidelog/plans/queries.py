"""The registered queries of the event engine and their DuckDB oracles.

Control tables are constants on both sides; ``NOW`` stands for the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import matches, split_provided
from ..functions.jsonschema import violations
from ..functions.validate import validate
from ..model import EVENT_COLUMNS, Config
from ..operators import cas, control, dlq, emit, evolve, fanout, inspect, poll, sweep
from ..sources.bus import BUS_SQL, bus_events
from ..sources.control_log import ControlLog
from ..sources.files import scratch
from ..sources.store import EventStore
from ..streaming import delivery
from ..streaming.managed import Subscriber

NOW = 1_705_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SUBSCRIPTIONS = [
    ("s1", "analytics", "subscriber", "bus.ui.*", 1000, None),
    ("s2", "analytics", "subscriber", "bus.ui.*", 2000, None),
    ("s3", "billing", "subscriber", "bus.acct.purchase@svc-1", 1500, None),
    ("s4", "audit", "subscriber", "*", 1200, None),
    ("s5", "audit", "subscriber", "*@svc-2", 1300, 1400),
    ("s6", "ops", "subscriber", "bus.acct.*@svc-3", 1700, None),
    ("s7", "catalog", "provider", "bus.ui.click, bus.ui.view", 1100, None),
    ("s8", "nested", "subscriber", "bus.ui.click.*", 1800, None),
    ("s9", "silent", "subscriber", "", 1900, None),
]
CURSORS = [
    ("c1", "s1", 100, 1100, 1000, None),
    ("c2", "s2", 0, None, 2000, None),
    ("c3", "s3", 200, None, 1500, None),
    ("c4", "s4", 900, 1300, 1200, None),
    ("c5", "s5", 50, None, 1300, 1400),
    ("c6", "s6", 0, None, 1700, None),
    ("c8", "s8", 300, None, 1800, None),
    ("c9", "s9", 99_999_999, None, 1900, None),
]
LETTERS = [
    (1, "c1", "s1", 101, '{"k": 1}', 4, "boom", 5000, None),
    (2, "c1", "s1", 103, "not json", 4, "boom", 6000, 7000),
    (3, "c5", "s5", 60, '{"k": 3}', 2, None, 6000, None),
    (4, "c3", "s3", 250, '{"k": 4}', 4, "late", 8000, 8100),
]
ATTEMPTS = [("c1", 110, 1), ("c1", 111, 4), ("c2", 5, 2), ("c3", 210, 7), ("c4", 901, 4)]
REGISTRY = [
    ("bus.ui.click", 1, 16384, "warn"),
    ("bus.ui.click", 2, 9, "cas-auto"),
    ("bus.acct.purchase", 1, 9, "strict"),
    ("bus.ui.view", 3, 9, "warn"),
]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


SUBS_SQL = _values("subs", "subscription_id, plugin, role, event_type_filter, registered_at, deregistered_at", SUBSCRIPTIONS)
CURS_SQL = _values("curs", "cursor_id, subscription_id, last_event_id, acked_at, created_at, deregistered_at", CURSORS)
DEAD_SQL = _values("dead", "dl_id, cursor_id, subscription_id, event_id, payload, attempts, last_error, dead_lettered_at, replay_requested_at", LETTERS)
TRY_SQL = _values("tries", "cursor_id, event_id, attempts", ATTEMPTS)
REG_SQL = _values("reg", "event_type, version, payload_max_bytes, payload_oversize", REGISTRY)
#: subs with their filters parsed, and whether a bus row is wanted by one.
WANTED_SQL = """
  (CASE WHEN split_part(f, '@', 2) <> '' THEN domain = split_part(f, '@', 2) ELSE TRUE END) AND
  (CASE WHEN split_part(f, '@', 1) = '*' THEN TRUE
        WHEN split_part(f, '@', 1) LIKE '%.*' THEN starts_with(event_type, left(split_part(f, '@', 1), length(split_part(f, '@', 1)) - 1)) AND length(event_type) > length(split_part(f, '@', 1)) - 1 AND position('.' IN substr(event_type, length(split_part(f, '@', 1)))) = 0
        ELSE event_type = split_part(f, '@', 1) AND split_part(f, '@', 1) <> '' END)"""


def subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIPTIONS, "subscription_id string, plugin string, role string, event_type_filter string, registered_at bigint, deregistered_at bigint")


def cursors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURSORS, "cursor_id string, subscription_id string, last_event_id bigint, acked_at bigint, created_at bigint, deregistered_at bigint")


def letters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LETTERS, "dl_id bigint, cursor_id string, subscription_id string, event_id bigint, payload string, attempts int, last_error string, dead_lettered_at bigint, replay_requested_at bigint")


def attempts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTEMPTS, "cursor_id string, event_id bigint, attempts int")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "event_type string, version int, payload_max_bytes int, payload_oversize string")


def query(sql: str | None = None, *ctes: str):
    """Registers a query, with its oracle over the bus view and further common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            tables = ", ".join([BUS_SQL, *ctes])
            body = sql.replace(":now", str(NOW))
            start = "WITH RECURSIVE " if body.startswith("RECURSIVE") else "WITH "
            body = body.removeprefix("RECURSIVE")
            ORACLES[f.__name__] = start + tables + ("" if body.startswith(",") else " ") + body  # a body may begin with more tables
        return f

    return add


POLLED = ("event_id", "event_type", "domain", "payload", "emitted_at")
_POLL = "SELECT event_id, event_type, domain, payload, emitted_at FROM bus WHERE {} ORDER BY event_id LIMIT {}"


@query(_POLL.format("event_type = 'bus.acct.purchase' AND event_id > 10 AND expires_at > :now", 100))
def poll_exact(spark, sf_dir):
    return poll.poll(bus_events(spark, sf_dir), 10, "bus.acct.purchase", NOW).select(*POLLED)


@query(_POLL.format("starts_with(event_type, 'bus.ui.') AND position('.' IN substr(event_type, 8)) = 0 AND event_id > 0 AND expires_at > :now", 100))
def poll_wildcard(spark, sf_dir):
    return poll.poll(bus_events(spark, sf_dir), 0, "bus.ui.*", NOW).select(*POLLED)


@query(_POLL.format("domain = 'svc-2' AND starts_with(event_type, 'bus.acct.') AND position('.' IN substr(event_type, 10)) = 0 AND event_id > 40 AND expires_at > :now", 50))
def poll_domain(spark, sf_dir):
    return poll.poll(bus_events(spark, sf_dir), 40, "bus.acct.*@svc-2", NOW, 50).select(*POLLED)


@query(_POLL.format("event_id > 500 AND expires_at > :now", 100))
def poll_catch_all(spark, sf_dir):
    return poll.poll(bus_events(spark, sf_dir), 500, "*", NOW).select(*POLLED)


@query("SELECT count(*) AS visible, count(*) FILTER (WHERE expires_at <= :now) * 0 AS leaked, min(event_id) AS first_visible FROM bus WHERE expires_at > :now")
def poll_expired(spark, sf_dir):
    rows = bus_events(spark, sf_dir).where(poll.visible(NOW))
    return rows.agg(F.count(F.lit(1)).alias("visible"), F.count_if(F.col("expires_at") <= NOW).alias("leaked"), F.min("event_id").alias("first_visible"))


@query("SELECT cursor_id, oldest, newest, coalesce(last_event_id < oldest - 1, FALSE) AS behind FROM curs, (SELECT min(event_id) AS oldest, max(event_id) AS newest FROM bus WHERE event_id > 120)", CURS_SQL)
def cursor_behind(spark, sf_dir):
    kept = bus_events(spark, sf_dir).where("event_id > 120")
    return poll.cursor_states(cursors(spark), kept).select("cursor_id", "oldest", "newest", "behind")


@query(", hits AS (SELECT c.cursor_id, b.event_id, row_number() OVER (PARTITION BY c.cursor_id ORDER BY b.event_id) AS n FROM bus b, (SELECT cursor_id, last_event_id, event_type_filter AS f FROM curs JOIN subs USING (subscription_id)) c WHERE b.event_id > c.last_event_id AND b.expires_at > :now AND " + WANTED_SQL + ") SELECT cursor_id, event_id FROM hits WHERE n <= 20", SUBS_SQL, CURS_SQL)
def poll_many(spark, sf_dir):
    subs = cursors(spark).join(subscriptions(spark).select("subscription_id", "event_type_filter"), "subscription_id")
    return poll.poll_many(bus_events(spark, sf_dir), subs, NOW, 20).select("cursor_id", "event_id")


def _tiers(spark, sf_dir):
    """Live rows from the last fortnight, warm ones up to a day into it: both tiers have that day."""
    rows = bus_events(spark, sf_dir)
    edge = 1_705_363_200_000
    live = rows.where(F.col("emitted_at") >= edge).withColumn("payload", F.lit("LIVE"))
    return live, rows.where(F.col("emitted_at") < edge + 86_400_000)


TIERS_SQL = """tiers AS (
  SELECT event_id, event_type, domain, 'LIVE' AS payload FROM bus WHERE emitted_at >= 1705363200000
  UNION ALL SELECT event_id, event_type, domain, payload FROM bus WHERE emitted_at < 1705363200000)"""


@query("SELECT event_id, event_type, payload FROM tiers WHERE event_id > (SELECT min(event_id) - 30 FROM bus WHERE emitted_at >= 1705363200000) ORDER BY event_id LIMIT 100", TIERS_SQL)
def tiered_poll(spark, sf_dir):
    live, warm = _tiers(spark, sf_dir)
    start = live.agg(F.min("event_id")).first()[0] - 30
    return poll.poll_tiered(live, warm, start).select("event_id", "event_type", "payload")


@query("SELECT event_id, event_type, payload FROM tiers WHERE event_id > 20 AND event_type = 'bus.ui.view' AND domain = 'svc-1' ORDER BY event_id LIMIT 1000", TIERS_SQL)
def tiered_poll_filtered(spark, sf_dir):
    live, warm = _tiers(spark, sf_dir)
    return poll.poll_tiered(live, warm, 20, {"event_type": "bus.ui.view", "domain": "svc-1"}, 1000).select("event_id", "event_type", "payload")


@query("SELECT payload, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT CASE WHEN payload = 'LIVE' THEN 'live' ELSE 'warm' END AS payload, event_id FROM tiers) GROUP BY payload", TIERS_SQL)
def tier_union(spark, sf_dir):
    rows = poll.prefer_live(*_tiers(spark, sf_dir))
    tier = F.when(F.col("payload") == "LIVE", "live").otherwise("warm")
    return rows.groupBy(tier.alias("payload")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("SELECT bucket, min(event_id) AS min_event_id, max(event_id) AS max_event_id, count(*) AS n FROM bus GROUP BY bucket")
def bucket_manifest(spark, sf_dir):
    return sweep.bucket_ranges(bus_events(spark, sf_dir))


@query(", m AS (SELECT bucket, min(event_id) AS lo, max(event_id) AS hi FROM bus GROUP BY bucket) SELECT bucket, count(*) AS n FROM bus WHERE bucket IN (SELECT bucket FROM m WHERE hi >= 300 AND lo <= 600) AND event_id BETWEEN 300 AND 600 GROUP BY bucket")
def bucket_pruned_scan(spark, sf_dir):
    rows = bus_events(spark, sf_dir)
    manifest = sweep.bucket_ranges(rows).withColumn("sealed_at", F.lit(1).cast("bigint"))
    kept = [r["bucket"] for r in poll.covering(manifest, 300, 600).collect()]
    return rows.where(F.col("bucket").isin(kept) & F.col("event_id").between(300, 600)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, emitted_at, dedup_expires_at FROM bus WHERE dedup_expires_at < :now ORDER BY event_id LIMIT 5000")
def sweep_candidates(spark, sf_dir):
    return sweep.candidates(bus_events(spark, sf_dir), NOW).select("event_id", "emitted_at", "dedup_expires_at")


@query("SELECT strftime(make_timestamp(emitted_at * 1000), '%Y-%m') AS month, bucket, count(*) AS n, min(event_id) AS lo FROM bus WHERE dedup_expires_at < :now GROUP BY 1, 2")
def sweep_by_bucket(spark, sf_dir):
    gone = sweep.sweep(bus_events(spark, sf_dir), NOW)[1]
    return gone.groupBy(sweep.month_of().alias("month"), "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"))


@query("SELECT count(*) AS kept, min(event_id) AS oldest FROM bus WHERE NOT dedup_expires_at < :now")
def sweep_survivors(spark, sf_dir):
    return sweep.sweep(bus_events(spark, sf_dir), NOW)[0].agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("oldest"))


@query("SELECT event_id FROM bus WHERE dedup_expires_at < :now AND event_id % 3 <> 0")
def archive_missing(spark, sf_dir):
    rows = bus_events(spark, sf_dir)
    return sweep.archive_missing(sweep.sweep(rows, NOW)[1], rows.where("event_id % 3 = 0")).select("event_id")


#: Every 11th row or so of the events is spoilt in one way.
SPOILT_SQL = """raw AS (SELECT event_id, CASE event_id % 11 WHEN 1 THEN '' WHEN 2 THEN 'bus.Bad' WHEN 3 THEN 'bus.' || repeat('x', 130) ELSE event_type END AS event_type,
  CASE WHEN event_id % 11 = 4 THEN repeat('d', 65) ELSE domain END AS domain, CASE WHEN event_id % 11 = 5 THEN repeat('s', 65) ELSE '' END AS subdomain,
  CASE event_id % 11 WHEN 6 THEN '[1]' WHEN 7 THEN 'oops' WHEN 8 THEN '{"k":"' || repeat('p', 300) || '"}' ELSE payload END AS payload,
  CASE event_id % 11 WHEN 9 THEN '1.0' WHEN 10 THEN '2.0.0' ELSE '1.0.0' END AS schema_version FROM bus)"""


@query(
    """SELECT event_id, CASE WHEN event_id % 11 = 10 THEN 'WB-005' WHEN event_id % 11 = 0 THEN NULL ELSE 'WB-001' END AS error_code,
  CASE event_id % 11 WHEN 1 THEN 'missing required fields' WHEN 2 THEN 'event_type does not match the pattern' WHEN 3 THEN 'event_type exceeds 128 chars' WHEN 4 THEN 'domain exceeds 64 chars' WHEN 5 THEN 'subdomain exceeds 64 chars'
   WHEN 6 THEN 'payload must be a valid JSON object' WHEN 7 THEN 'payload must be a valid JSON object' WHEN 8 THEN 'payload exceeds max_payload_bytes' WHEN 9 THEN 'invalid schema_version format' WHEN 10 THEN 'schema_version is not supported' END AS violation FROM raw""",
    SPOILT_SQL,
)
def emit_validate(spark, sf_dir):
    k = F.col("event_id") % 11
    pick = lambda column, **to: F.coalesce(*[F.when(k == int(n[1:]), v) for n, v in to.items()], F.col(column))
    rows = bus_events(spark, sf_dir).withColumns({
        "event_type": pick("event_type", _1=F.lit(""), _2=F.lit("bus.Bad"), _3=F.concat(F.lit("bus."), F.repeat(F.lit("x"), 130))),
        "domain": pick("domain", _4=F.repeat(F.lit("d"), 65)),
        "subdomain": pick("subdomain", _5=F.repeat(F.lit("s"), 65)),
        "payload": pick("payload", _6=F.lit("[1]"), _7=F.lit("oops"), _8=F.concat(F.lit('{"k":"'), F.repeat(F.lit("p"), 300), F.lit('"}'))),
        "schema_version": pick("schema_version", _9=F.lit("1.0"), _10=F.lit("2.0.0")),
    })
    return validate(rows, Config(max_payload_bytes=256)).select("event_id", "error_code", "violation")


KEYED_SQL = "keyed AS (SELECT event_id AS ordinal, 'k-' || CAST(event_id % 700 AS VARCHAR) AS idempotency_key FROM bus)"


def _keyed(spark, sf_dir):
    return bus_events(spark, sf_dir).select(F.col("event_id").alias("ordinal"), F.concat(F.lit("k-"), (F.col("event_id") % 700).cast("string")).alias("idempotency_key"))


@query("SELECT min(ordinal) AS ordinal, idempotency_key FROM keyed GROUP BY idempotency_key", KEYED_SQL)
def emit_dedup(spark, sf_dir):
    return emit.first_of_key(_keyed(spark, sf_dir))[0]


@query("SELECT idempotency_key, ordinal, original_event_id FROM keyed JOIN (SELECT 'k-' || CAST(event_id AS VARCHAR) AS idempotency_key, event_id AS original_event_id FROM bus WHERE event_id < 400) USING (idempotency_key)", KEYED_SQL)
def emit_duplicates(spark, sf_dir):
    log = bus_events(spark, sf_dir).where("event_id < 400").select("event_id", F.concat(F.lit("k-"), F.col("event_id").cast("string")).alias("idempotency_key"))
    return emit.split_known(_keyed(spark, sf_dir), log)[1]


#: As above, over the whole log.
KEYED_ALL_SQL = "keyed AS (SELECT event_id AS ordinal, 'k-' || CAST(event_id % 700 AS VARCHAR) AS idempotency_key FROM bus)"


def _keyed_all(spark, sf_dir):
    return bus_events(spark, sf_dir).select(F.col("event_id").alias("ordinal"), F.concat(F.lit("k-"), (F.col("event_id") % 700).cast("string")).alias("idempotency_key"))


@query("SELECT min(ordinal) AS ordinal, idempotency_key FROM keyed GROUP BY idempotency_key", KEYED_ALL_SQL)
def emit_dedup_all(spark, sf_dir):
    return emit.first_of_key(_keyed_all(spark, sf_dir))[0]


@query("SELECT idempotency_key, ordinal, original_event_id FROM keyed JOIN (SELECT 'k-' || CAST(event_id AS VARCHAR) AS idempotency_key, event_id AS original_event_id FROM bus WHERE event_id < 400) USING (idempotency_key)", KEYED_ALL_SQL)
def emit_duplicates_all(spark, sf_dir):
    log = bus_events(spark, sf_dir).where("event_id < 400").select("event_id", F.concat(F.lit("k-"), F.col("event_id").cast("string")).alias("idempotency_key"))
    return emit.split_known(_keyed_all(spark, sf_dir), log)[1]


@query("SELECT emitted_at, idempotency_key, 7000 + row_number() OVER (ORDER BY event_id) AS event_id FROM bus")
def id_assign(spark, sf_dir):
    rows = bus_events(spark, sf_dir).withColumn("ordinal", F.col("event_id")).drop("event_id")
    return emit.assign_ids(rows, 7000).select("emitted_at", "idempotency_key", "event_id")


@query("SELECT emitted_at, idempotency_key, 7000 + row_number() OVER (ORDER BY event_id) AS event_id FROM bus")
def id_assign_all(spark, sf_dir):
    rows = bus_events(spark, sf_dir).withColumn("ordinal", F.col("event_id")).drop("event_id")
    return emit.assign_ids(rows, 7000).select("emitted_at", "idempotency_key", "event_id")


@query("SELECT event_type, version, payload_max_bytes, payload_oversize FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY version DESC) AS n FROM reg) WHERE n = 1", REG_SQL)
def schema_latest(spark, sf_dir):
    return emit.latest_schemas(registry(spark))


@query(
    """SELECT event_id, version AS registry_schema_version, CASE WHEN over AND payload_oversize = 'strict' THEN 'WB-008' END AS error_code,
  CASE WHEN over AND payload_oversize = 'cas-auto' THEN sha256(payload) END AS payload_cas_sha,
  CASE WHEN over AND payload_oversize = 'cas-auto' THEN '{"$cas":"' || sha256(payload) || '"}' ELSE payload END AS payload,
  CASE WHEN over AND payload_oversize <> 'strict' THEN 1 ELSE 0 END AS n_warnings
  FROM (SELECT b.*, version, payload_oversize, coalesce(strlen(payload) > payload_max_bytes, FALSE) AS over FROM bus b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY version DESC) AS n FROM reg) WHERE n = 1) r USING (event_type))""",
    REG_SQL,
)
def payload_policy(spark, sf_dir):
    table = registry(spark).withColumn("json_schema", F.lit("{}"))
    rows = emit.apply_registry(bus_events(spark, sf_dir), table)
    return rows.select("event_id", "registry_schema_version", "error_code", "payload_cas_sha", "payload", F.size("warnings").alias("n_warnings"))


@query("SELECT event_id, CASE WHEN CAST(payload->>'k' AS INTEGER) > 50 THEN 1 ELSE 0 END + CASE WHEN CAST(payload->>'k' AS INTEGER) < 10 THEN 1 ELSE 0 END + 1 AS n FROM bus")
def json_schema_check(spark, sf_dir):
    schema = {"type": "object", "required": ["k", "absent"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 50}}, "additionalProperties": False}
    return bus_events(spark, sf_dir).select("event_id", F.size(violations(schema, F.try_parse_json("payload"))).alias("n"))


@query("SELECT sha256(text) AS sha, strlen(text) AS size FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND strlen(text) <= 5000)")
def cas_put(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("content"))
    return cas.put(docs, None, NOW, 5000)[0].select("sha", "size")


@query("SELECT count(*) AS objects, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def cas_stats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("content"))
    return cas.stats(cas.put(docs, None, NOW)[0])


@query(
    """SELECT (SELECT count(DISTINCT sha) FROM objects WHERE doc_id % 4 = 0) AS live_shas, (SELECT count(*) FROM stored) AS considered,
  count(*) FILTER (WHERE NOT fresh) AS deleted, count(*) FILTER (WHERE fresh) AS skipped_in_grace, CAST(coalesce(sum(size) FILTER (WHERE NOT fresh), 0) AS BIGINT) AS bytes_freed
  FROM (SELECT *, :now - mtime < 604800000 AS fresh FROM stored WHERE sha NOT IN (SELECT sha FROM objects WHERE doc_id % 4 = 0))""",
    "objects AS (SELECT doc_id, sha256(text) AS sha, strlen(text) AS size FROM documents WHERE text IS NOT NULL)",
    f"stored AS (SELECT sha, min(size) AS size, {NOW} - min(doc_id) * 1000000 AS mtime FROM objects GROUP BY sha)",
)
def cas_gc(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("size"))
    stored = docs.groupBy("sha").agg(F.min("size").alias("size"), (F.lit(NOW) - F.min("doc_id") * 1_000_000).alias("mtime"))
    live = cas.referenced(docs.where("doc_id % 4 = 0").select(F.col("sha").alias("payload_cas_sha")))
    return cas.gc_summary(stored, live, NOW)


@query("SELECT count(*) AS total_events, min(event_id) AS oldest_event_id, max(event_id) AS newest_event_id FROM bus")
def status_totals(spark, sf_dir):
    return inspect.totals(bus_events(spark, sf_dir))


@query("SELECT event_type, count(*) AS n FROM bus GROUP BY event_type")
def status_by_type(spark, sf_dir):
    return inspect.counts_by(bus_events(spark, sf_dir), "event_type")


@query("SELECT emitted_at // 3600000 * 3600000 AS hour_ms, count(*) AS n FROM bus WHERE emitted_at >= :now - 86400000 AND emitted_at < :now GROUP BY 1")
def events_per_hour(spark, sf_dir):
    return inspect.per_hour(bus_events(spark, sf_dir), NOW - 86_400_000, NOW)


@query("SELECT event_type, count(*) AS n FROM bus GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def top_types(spark, sf_dir):
    return inspect.counts_by(bus_events(spark, sf_dir), "event_type", 5)


@query("SELECT domain, count(*) AS n FROM bus GROUP BY domain ORDER BY n DESC, domain LIMIT 20")
def top_domains(spark, sf_dir):
    return inspect.counts_by(bus_events(spark, sf_dir), "domain", 20)


@query("SELECT * FROM (SELECT 'oldest' AS which, event_id, event_type, emitted_at FROM bus ORDER BY event_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'newest', event_id, event_type, emitted_at FROM bus ORDER BY event_id DESC LIMIT 1)")
def oldest_newest(spark, sf_dir):
    return inspect.ends(bus_events(spark, sf_dir))


JOINED_SQL = "joined AS (SELECT s.*, c.cursor_id, c.last_event_id, c.acked_at, c.created_at AS cursor_created_at FROM subs s JOIN curs c USING (subscription_id) WHERE s.deregistered_at IS NULL AND c.deregistered_at IS NULL)"


@query("SELECT subscription_id, plugin, cursor_id, (SELECT max(event_id) FROM bus) - last_event_id AS lag FROM joined", SUBS_SQL, CURS_SQL, JOINED_SQL)
def subscriber_lag(spark, sf_dir):
    both = control.with_cursors(subscriptions(spark), cursors(spark))
    return inspect.subscriber_lag(both, bus_events(spark, sf_dir)).select("subscription_id", "plugin", "cursor_id", "lag")


@query("SELECT cursor_id, greatest(0, (SELECT max(event_id) FROM bus) - last_event_id) AS cursor_lag, :now - (SELECT min(emitted_at) FROM bus WHERE event_id > c.last_event_id AND expires_at > :now) AS oldest_unacked_age_ms, (SELECT count(*) FROM dead d WHERE d.cursor_id = c.cursor_id) AS dlq_count FROM curs c", CURS_SQL, DEAD_SQL)
def cursor_lag(spark, sf_dir):
    return inspect.cursor_lag(cursors(spark), bus_events(spark, sf_dir), letters(spark), NOW)


@query("SELECT subscription_id, plugin, event_type_filter, registered_at FROM subs WHERE deregistered_at IS NULL AND role = 'subscriber'", SUBS_SQL)
def list_active(spark, sf_dir):
    return control.list_subscriptions(subscriptions(spark), "subscriber").select("subscription_id", "plugin", "event_type_filter", "registered_at")


@query("SELECT subscription_id, trim(f) AS provided FROM (SELECT subscription_id, unnest(string_split(event_type_filter, ',')) AS f FROM subs WHERE role = 'provider')", SUBS_SQL)
def provider_filters(spark, sf_dir):
    rows = control.active(subscriptions(spark), "provider")
    return rows.select("subscription_id", F.explode(split_provided(F.col("event_type_filter"))).alias("provided"))


@query("SELECT subscription_id, cursor_id, last_event_id FROM joined WHERE plugin = 'analytics' AND event_type_filter = 'bus.ui.*' ORDER BY registered_at DESC LIMIT 1", SUBS_SQL, CURS_SQL, JOINED_SQL)
def resume_subscription(spark, sf_dir):
    return control.resume(subscriptions(spark), cursors(spark), "analytics", "bus.ui.*").select("subscription_id", "cursor_id", "last_event_id")


@query("SELECT cursor_id, greatest(last_event_id, coalesce(top, 0)) AS last_event_id, CASE WHEN top IS NOT NULL THEN :now ELSE acked_at END AS acked_at FROM curs LEFT JOIN (SELECT 'c' || CAST(event_id % 7 AS VARCHAR) AS cursor_id, max(event_id) AS top FROM bus GROUP BY 1) USING (cursor_id)", CURS_SQL)
def ack_many(spark, sf_dir):
    acks = bus_events(spark, sf_dir).select("event_id", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("cursor_id"))
    return poll.ack_forward(cursors(spark), acks, NOW).select("cursor_id", "last_event_id", "acked_at")


@query("SELECT cursor_id, greatest(last_event_id, coalesce(top, 0)) AS last_event_id, CASE WHEN top IS NOT NULL THEN :now ELSE acked_at END AS acked_at FROM curs LEFT JOIN (SELECT 'c' || CAST(event_id % 7 AS VARCHAR) AS cursor_id, max(event_id) AS top FROM bus GROUP BY 1) USING (cursor_id)", CURS_SQL)
def ack_many_all(spark, sf_dir):
    acks = bus_events(spark, sf_dir).select("event_id", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("cursor_id"))
    return poll.ack_forward(cursors(spark), acks, NOW).select("cursor_id", "last_event_id", "acked_at")


@query("SELECT cursor_id, arg_max(event_id, event_id) AS last_event_id, arg_max(event_type, event_id) AS event_type FROM (SELECT domain AS cursor_id, * FROM bus) GROUP BY cursor_id")
def control_fold(spark, sf_dir):
    changes = bus_events(spark, sf_dir).select(F.col("domain").alias("cursor_id"), F.col("event_id").alias("last_event_id"), "event_type", F.col("event_id").alias("seq"))
    return control.fold(changes, "cursor_id")


@query("SELECT dl_id, cursor_id, event_id, plugin, attempts, dead_lettered_at FROM dead LEFT JOIN (SELECT subscription_id, plugin FROM subs) USING (subscription_id) ORDER BY dead_lettered_at DESC, dl_id DESC LIMIT 3", DEAD_SQL, SUBS_SQL)
def dlq_list(spark, sf_dir):
    return dlq.list_dead_letters(letters(spark), subscriptions(spark), limit=3).select("dl_id", "cursor_id", "event_id", "plugin", "attempts", "dead_lettered_at")


@query("SELECT dl_id, plugin FROM dead JOIN (SELECT subscription_id, plugin FROM subs WHERE plugin = 'audit') USING (subscription_id)", DEAD_SQL, SUBS_SQL)
def dlq_by_plugin(spark, sf_dir):
    return dlq.list_dead_letters(letters(spark), subscriptions(spark), plugin="audit").select("dl_id", "plugin")


@query("SELECT dl_id, dl_id <> 2 AS payload_ok, CASE WHEN dl_id = 2 THEN 'WB-001' END AS error_code FROM dead WHERE replay_requested_at IS NOT NULL", DEAD_SQL)
def dlq_pending(spark, sf_dir):
    return dlq.parse_payload(dlq.pending_replays(letters(spark))).select("dl_id", "payload_ok", "error_code")


@query("SELECT t.cursor_id, subscription_id, t.event_id, event_type, domain, attempts FROM tries t JOIN bus b ON t.event_id = b.event_id JOIN curs c ON c.cursor_id = t.cursor_id WHERE attempts > 3", TRY_SQL, CURS_SQL)
def dead_lettering(spark, sf_dir):
    failed = dlq.exhausted(attempts(spark), 3).withColumn("last_error", F.lit("boom"))
    rows = dlq.to_dead_letters(failed, bus_events(spark, sf_dir), cursors(spark), NOW)
    return rows.select("cursor_id", "subscription_id", "event_id", "event_type", "domain", "attempts")


@query("SELECT cursor_id, event_id, CASE WHEN attempts = 1 THEN 100 WHEN attempts = 2 THEN 500 ELSE 2000 END AS wait_ms FROM tries", TRY_SQL)
def backoff_schedule(spark, sf_dir):
    return attempts(spark).select("cursor_id", "event_id", dlq.backoff_ms(F.col("attempts"), [100, 500, 2000]).alias("wait_ms"))


FANNED_SQL = "fanned AS (SELECT c.cursor_id, b.* FROM bus b, (SELECT cursor_id, last_event_id, event_type_filter AS f FROM curs JOIN subs USING (subscription_id)) c WHERE b.event_id > c.last_event_id AND " + WANTED_SQL + ")"


def _fanned(spark, sf_dir):
    subs = cursors(spark).join(subscriptions(spark).select("subscription_id", "event_type_filter"), "subscription_id")
    return fanout.fan_out(bus_events(spark, sf_dir), subs)


@query("SELECT cursor_id, event_id FROM fanned", SUBS_SQL, CURS_SQL, FANNED_SQL)
def fanout_all(spark, sf_dir):
    return _fanned(spark, sf_dir).select("cursor_id", "event_id")


@query("SELECT cursor_id, count(*) AS n, sum(CASE WHEN strlen(payload) <= 9 THEN 1 ELSE 0 END)::BIGINT AS inlined FROM fanned GROUP BY cursor_id", SUBS_SQL, CURS_SQL, FANNED_SQL)
def fanout_inline_pointer(spark, sf_dir):
    rows = fanout.inline_or_pointer(_fanned(spark, sf_dir).withColumn("body", F.col("payload")), ["body"], 9 + len('{"body":""}') + 2)
    return rows.groupBy("cursor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event").isNotNull()).alias("inlined"))


@query("SELECT cursor_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY cursor_id ORDER BY event_id DESC) AS r FROM fanned) WHERE r <= 256", SUBS_SQL, CURS_SQL, FANNED_SQL)
def queue_drop_oldest(spark, sf_dir):
    return fanout.bounded_queue(_fanned(spark, sf_dir)).select("cursor_id", "event_id")


@query("SELECT cursor_id, count(*) AS offered, least(count(*), 256) AS queued, greatest(count(*) - 256, 0) AS dropped FROM fanned GROUP BY cursor_id", SUBS_SQL, CURS_SQL, FANNED_SQL)
def queue_counters(spark, sf_dir):
    return fanout.queue_counters(_fanned(spark, sf_dir))


@query("SELECT event_id, event_type, parent_event_id FROM bus WHERE correlation_id = 'user-3'")
def trace_flat(spark, sf_dir):
    return inspect.trace(bus_events(spark, sf_dir, parents=True), "user-3").select("event_id", "event_type", "parent_event_id")


@query("RECURSIVE, t AS (SELECT event_id, parent_event_id FROM bus WHERE correlation_id = 'user-5'), tree AS (SELECT event_id, parent_event_id, 0 AS depth FROM t WHERE parent_event_id IS NULL UNION ALL SELECT t.event_id, t.parent_event_id, tree.depth + 1 FROM t JOIN tree ON t.parent_event_id = tree.event_id) SELECT event_id, parent_event_id, depth FROM tree")
def trace_tree(spark, sf_dir):
    return inspect.trace_tree(bus_events(spark, sf_dir, parents=True), "user-5")


@query("SELECT event_id, parent_event_id FROM bus")
def causal_chain(spark, sf_dir):
    return emit.chain_parents(bus_events(spark, sf_dir)).select("event_id", "parent_event_id")


@query("SELECT after, before FROM (SELECT lag(event_id) OVER (ORDER BY event_id) AS after, event_id AS before FROM bus WHERE event_id % 13 <> 5) WHERE before - after > 1")
def gap_check(spark, sf_dir):
    return poll.gaps(bus_events(spark, sf_dir).where("event_id % 13 <> 5"), 512)


@query("SELECT event_id, event_type, domain, subdomain, payload, emitted_at, expires_at, CAST(NULL AS BIGINT) AS parent_event_id, session_id, correlation_id, CAST(NULL AS VARCHAR) AS producer_id, CAST(NULL AS VARCHAR) AS payload_cas_sha FROM bus WHERE event_id > 100 AND domain = 'svc-1' AND session_id = 's-2' ORDER BY event_id LIMIT 50")
def api_events(spark, sf_dir):
    return inspect.api_events(bus_events(spark, sf_dir), 100, 50, domain="svc-1", session_id="s-2")


@query("SELECT event_id, event_type, emitted_at FROM bus ORDER BY event_id DESC LIMIT 25")
def latest_n(spark, sf_dir):
    return inspect.latest(bus_events(spark, sf_dir), 25).select("event_id", "event_type", "emitted_at")


@query("SELECT event_id FROM bus WHERE emitted_at >= :now - 172800000 AND emitted_at < :now AND domain = 'svc-0'")
def span_query(spark, sf_dir):
    rows = bus_events(spark, sf_dir).where(F.col("emitted_at").between(NOW - 172_800_000, NOW - 1))
    return rows.where(matches("*@svc-0")).select("event_id")


@query("SELECT count(*) AS would_delete FROM bus WHERE dedup_expires_at < :now")
def sweep_dry_run(spark, sf_dir):
    return sweep.sweep(bus_events(spark, sf_dir), NOW)[1].agg(F.count(F.lit(1)).alias("would_delete"))


@query("SELECT c.cursor_id, s.plugin, s.event_type_filter, c.last_event_id, (SELECT max(event_id) FROM bus) - c.last_event_id AS behind, s.deregistered_at IS NOT NULL AS gone FROM curs c JOIN subs s USING (subscription_id)", SUBS_SQL, CURS_SQL)
def cursor_diagnostics(spark, sf_dir):
    newest = bus_events(spark, sf_dir).agg(F.max("event_id").alias("newest"))
    subs = subscriptions(spark).select("subscription_id", "plugin", "event_type_filter", F.col("deregistered_at").isNotNull().alias("gone"))
    rows = cursors(spark).join(subs, "subscription_id").crossJoin(F.broadcast(newest))
    return rows.select("cursor_id", "plugin", "event_type_filter", "last_event_id", (F.col("newest") - F.col("last_event_id")).alias("behind"), "gone")


@query("SELECT cursor_id, CASE WHEN cursor_id = 'c4' THEN 249 ELSE last_event_id END AS last_event_id, acked_at FROM curs", CURS_SQL)
def replay_cursor(spark, sf_dir):
    return poll.replay(cursors(spark), bus_events(spark, sf_dir), "c4", 250).select("cursor_id", "last_event_id", "acked_at")


@query("SELECT t.cursor_id, t.event_id, b.event_type, b.payload FROM tries t LEFT JOIN bus b USING (event_id)", TRY_SQL)
def resolve_pointers(spark, sf_dir):
    return fanout.resolve_pointers(attempts(spark), bus_events(spark, sf_dir)).select("cursor_id", "event_id", "event_type", "payload")


@query("SELECT cursor_id, min(ms) AS degraded_at FROM (SELECT *, ms - min(ms) OVER (PARTITION BY cursor_id, run) AS held FROM (SELECT *, sum(CASE WHEN depth >= 192 THEN 0 ELSE 1 END) OVER (PARTITION BY cursor_id ORDER BY ms) AS run FROM (SELECT domain AS cursor_id, event_id * 1000 AS ms, (event_id * 7919) % 1000 AS depth FROM bus)) WHERE depth >= 192) WHERE held >= 30000 GROUP BY cursor_id")
def queue_degrade(spark, sf_dir):
    depths = bus_events(spark, sf_dir).select(F.col("domain").alias("cursor_id"), (F.col("event_id") * 1000).alias("at"), ((F.col("event_id") * 7919) % 1000).alias("depth"))
    return fanout.degrade_points(depths)


@query("SELECT event_id, event_type, subdomain, schema_version, correlation_id FROM (SELECT event_id, event_type, '' AS subdomain, '1.0.0' AS schema_version, CASE WHEN event_id > 500 THEN correlation_id END AS correlation_id FROM bus)")
def schema_evolution(spark, sf_dir):
    rows = bus_events(spark, sf_dir)
    old = rows.where("event_id <= 500").select("event_id", "event_type", "domain", "payload", "idempotency_key", "emitted_at", "expires_at", "dedup_expires_at")
    return evolve.united(old, rows.where("event_id > 500")).select("event_id", "event_type", "subdomain", "schema_version", "correlation_id")


@query("SELECT domain, event_type, count(*) AS n FROM bus GROUP BY CUBE (domain, event_type)")
def cube_by_domain_type(spark, sf_dir):
    return bus_events(spark, sf_dir).cube("domain", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT sha256(payload) AS sha FROM bus WHERE payload NOT IN (SELECT payload FROM bus WHERE event_id % 2 = 1 AND event_id < 100)")
def cas_missing(spark, sf_dir):
    rows = bus_events(spark, sf_dir)
    store = cas.put(rows.where("event_id % 2 = 1 AND event_id < 100").select(F.col("payload").alias("content")), None, NOW)[0]
    return cas.put(rows.select(F.col("payload").alias("content")), store, NOW)[0].select("sha")


@query("SELECT DISTINCT sha256(payload) AS sha FROM bus WHERE payload NOT IN (SELECT payload FROM bus WHERE event_id % 2 = 1 AND event_id < 100)")
def cas_missing_all(spark, sf_dir):
    rows = bus_events(spark, sf_dir)
    store = cas.put(rows.where("event_id % 2 = 1 AND event_id < 100").select(F.col("payload").alias("content")), None, NOW)[0]
    return cas.put(rows.select(F.col("payload").alias("content")), store, NOW)[0].select("sha")


#: A batch in which every 11th event has a bad type, keys repeat every 5,000 events, and the log has the first 399 keys.
WHOLE_SQL = """whole AS (SELECT *, event_id AS ordinal, 'k-' || CAST(event_id % 5000 AS VARCHAR) AS key, event_id % 11 = 2 AS bad FROM bus),
firsts AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS nth FROM whole WHERE NOT bad),
taken AS (SELECT *, 9000 + row_number() OVER (ORDER BY ordinal) AS new_id FROM firsts WHERE nth = 1 AND key NOT IN (SELECT 'k-' || CAST(event_id AS VARCHAR) FROM bus WHERE event_id < 400))"""


def _whole_batch(spark, sf_dir):
    rows = bus_events(spark, sf_dir).drop("event_id", "emitted_at", "expires_at", "dedup_expires_at", "bucket")
    ids = bus_events(spark, sf_dir).select(F.col("event_id").alias("ordinal"), F.col("idempotency_key"))
    rows = rows.join(ids, "idempotency_key").withColumns({"idempotency_key": F.concat(F.lit("k-"), (F.col("ordinal") % 5000).cast("string")), "event_type": F.when(F.col("ordinal") % 11 == 2, "bus.Bad").otherwise(F.col("event_type"))})
    log = bus_events(spark, sf_dir).where("event_id < 400").withColumn("idempotency_key", F.concat(F.lit("k-"), F.col("event_id").cast("string")))
    return emit.emit_batch(rows, log, None, NOW, 9000)


@query("SELECT ordinal, new_id AS event_id, key AS idempotency_key, lag(new_id) OVER (PARTITION BY correlation_id ORDER BY new_id) AS parent_event_id, :now + 259200000 AS expires_at FROM taken", WHOLE_SQL)
def emit_accepted(spark, sf_dir):
    return _whole_batch(spark, sf_dir)[0].select("ordinal", "event_id", "idempotency_key", "parent_event_id", "expires_at")


@query("SELECT ordinal, CASE WHEN bad THEN 'WB-001' ELSE 'WB-002' END AS error_code FROM whole WHERE ordinal NOT IN (SELECT ordinal FROM taken)", WHOLE_SQL)
def emit_rejected(spark, sf_dir):
    return _whole_batch(spark, sf_dir)[1].select("ordinal", "error_code")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'live' ELSE 'warm' END AS tier, payload FROM bus")
def store_life(spark, sf_dir):
    """Odd events are emitted first, even ones a month later; a sweep in between moves the first; ids are mapped back by key."""
    store = EventStore(spark, f"{scratch(spark, 'store')}")
    rows = bus_events(spark, sf_dir)
    batch = rows.select(F.col("event_id").alias("ordinal"), "event_type", "domain", "payload", "idempotency_key")
    store.emit(batch.where("ordinal % 2 = 1"), NOW)
    store.emit(batch.where("ordinal % 2 = 0"), NOW + 31 * 86_400_000)
    store.sweep(NOW + 2 * 86_400_000, (1 << 31) - 1)
    tiers = store.live().select("idempotency_key", "payload", F.lit("live").alias("tier")).unionByName(store.warm().select("idempotency_key", "payload", F.lit("warm").alias("tier")))
    return rows.select("event_id", "idempotency_key").join(tiers.hint("merge"), "idempotency_key").select("event_id", "tier", "payload")


@query("SELECT cursor_id, CASE WHEN cursor_id = 'c4' THEN 17 ELSE last_event_id END AS last_event_id, CASE WHEN cursor_id = 'c4' THEN :now ELSE acked_at END AS acked_at FROM curs", CURS_SQL)
def ack_cursor(spark, sf_dir):
    return poll.ack(cursors(spark), "c4", 17, NOW).select("cursor_id", "last_event_id", "acked_at")


@query("SELECT event_id, event_type FROM bus WHERE event_id > 900 AND expires_at > :now ORDER BY event_id LIMIT 60")
def poll_by_cursor(spark, sf_dir):
    return poll.poll_cursor(bus_events(spark, sf_dir), cursors(spark), subscriptions(spark), "c4", NOW, 60).select("event_id", "event_type")


@query("SELECT subscription_id, cursor_id, s.deregistered_at AS sub_gone, c.gone AS cursor_gone FROM (SELECT subscription_id, CASE WHEN subscription_id = 's1' THEN :now ELSE deregistered_at END AS deregistered_at FROM subs) s JOIN (SELECT subscription_id, cursor_id, CASE WHEN subscription_id = 's1' THEN :now ELSE deregistered_at END AS gone FROM curs) c USING (subscription_id)", SUBS_SQL, CURS_SQL)
def deregistered(spark, sf_dir):
    subs, curs = control.deregister(subscriptions(spark), cursors(spark), "s1", NOW)
    return subs.select("subscription_id", F.col("deregistered_at").alias("sub_gone")).join(curs.select("subscription_id", "cursor_id", F.col("deregistered_at").alias("cursor_gone")), "subscription_id")


@query("SELECT event_id AS dl_id, CASE WHEN event_id = 582 THEN 2 ELSE 1 END AS attempts, CASE WHEN event_id % 2 = 0 AND event_id <> 582 THEN :now END AS replay_requested_at FROM bus WHERE event_id % 97 = 0 AND (event_id % 2 = 1 OR event_id >= 582)")
def dlq_drained(spark, sf_dir):
    """Every 97th event is a letter; the even ones are tried in order until 582 fails."""
    rows = bus_events(spark, sf_dir).where("event_id % 97 = 0")
    dead = rows.select(F.col("event_id").alias("dl_id"), "payload", F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.when(F.col("event_id") % 2 == 0, NOW).cast("bigint").alias("replay_requested_at"))

    def handler(letter: dict) -> None:
        if letter["dl_id"] == 582:
            raise ValueError("boom")

    return dlq.drain_replays(dead, handler).select("dl_id", "attempts", "replay_requested_at")


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS size FROM documents WHERE text IS NOT NULL")
def cas_get(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    store = cas.put(docs.select(F.col("text").alias("content")), None, NOW)[0]
    return cas.get(docs.select("doc_id", F.sha2("text", 256).alias("sha")), store).select("doc_id", "sha", "size")


@query("SELECT event_id, CASE WHEN nth % 7 = 0 THEN 'dead' ELSE 'delivered' END AS outcome FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS nth FROM bus WHERE event_id > 100 AND expires_at > :now AND starts_with(event_type, 'bus.ui.') AND position('.' IN substr(event_type, 8)) = 0) WHERE nth <= 50")
def managed_batch(spark, sf_dir):
    """One batch of a managed subscription whose handler refuses every seventh event for good."""
    table = ControlLog(spark, scratch(spark, "control"))
    table.put("subscriptions", subscriptions(spark).withColumns({"schema_version": F.lit(None).cast("string"), "health_check_interval_ms": F.lit(None).cast("bigint")}))
    table.put("cursors", cursors(spark).withColumns({"push_socket_addr": F.lit(None).cast("string"), "lag_estimate": F.lit(None).cast("bigint")}))
    seen: list[int] = []

    def handler(e: dict) -> None:
        if e["event_id"] not in seen:
            seen.append(e["event_id"])
        if len(seen) % 7 == 0:
            raise ValueError("refused")

    rows = bus_events(spark, sf_dir).drop("bucket")
    Subscriber(table, lambda: rows, "c1", handler, max_retries=1, backoff_ms=(0,), clock=lambda: NOW).tick()
    dead = table.read("dead_letters").select("event_id", F.lit("dead").alias("outcome"))
    delivered = spark.createDataFrame([(x,) for x in seen], "event_id bigint").join(dead.select("event_id"), "event_id", "left_anti")
    return dead.unionByName(delivered.select("event_id", F.lit("delivered").alias("outcome")))


def _streamed(spark, sf_dir, make, schema: str, files_per_trigger: int | None = 1):
    """Runs a stream over the bus events, split in a few files, to its end, and reads what it appended."""
    folder = scratch(spark, "stream")
    bus_events(spark, sf_dir).select(*EVENT_COLUMNS).repartitionByRange(3, "event_id").write.parquet(f"{folder}/live")
    sink = lambda rows, batch: rows.write.mode("append").parquet(f"{folder}/out")
    delivery.start(make(delivery.event_stream(spark, f"{folder}/live", files_per_trigger)), f"{folder}/checkpoint", sink).awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("SELECT event_id, event_type FROM bus WHERE starts_with(event_type, 'bus.acct.') AND position('.' IN substr(event_type, 10)) = 0 AND domain = 'svc-1'")
def stream_subscription(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: delivery.subscription(e, "bus.acct.*@svc-1").select("event_id", "event_type"), "event_id bigint, event_type string")


@query("SELECT cursor_id, event_id FROM fanned", SUBS_SQL, CURS_SQL, FANNED_SQL)
def stream_fanout(spark, sf_dir):
    subs = cursors(spark).join(subscriptions(spark).select("subscription_id", "event_type_filter"), "subscription_id")
    return _streamed(spark, sf_dir, lambda e: delivery.pushed(e, subs).select("cursor_id", "event_id"), "cursor_id string, event_id bigint")


@query("SELECT event_id, idempotency_key FROM bus")
def stream_dedup(spark, sf_dir):
    # every event comes twice in one batch; the twin is dropped by its key
    twice = lambda e: delivery.deduplicated(e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))
    return _streamed(spark, sf_dir, lambda e: twice(e).select("event_id", "idempotency_key"), "event_id bigint, idempotency_key string", None)
