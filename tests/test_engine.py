"""The engine's behaviour on small logs: filters, cursors, tiers, sweeps, emission, registry, control, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.filters import event_keys, matches, parse, parsed
from tidelog.functions.jsonschema import violations
from tidelog.functions.validate import validate
from tidelog.model import EVENT, EVENT_COLUMNS, BusError, Config
from tidelog.operators import cas, control, dlq, emit, fanout, inspect, poll, sweep
from tidelog.sources.store import EventStore
from tidelog.streaming import delivery

APRIL, MAY, JUNE = 1_775_001_600_000, 1_777_593_600_000, 1_780_272_000_000  # UTC month starts of 2026


def event(i, event_type="bus.test.fired", domain="d", emitted=None, dedup=1, payload=None, **more):
    at = emitted if emitted is not None else 1_700_000_000_000 + i
    row = {"event_id": i, "event_type": event_type, "domain": domain, "subdomain": "", "payload": payload or json.dumps({"n": i}), "schema_version": "1.0.0", "idempotency_key": f"evt-{i}", "emitted_at": at, "expires_at": at + 86_400_000, "dedup_expires_at": dedup} | more
    return tuple(row.get(c) for c in EVENT_COLUMNS)


def log(spark, ids, **more):
    return spark.createDataFrame([event(i, **more) for i in ids], EVENT)


def ids(df):
    return [r.event_id for r in df.collect()]


def naive(event_type, domain, text):
    pattern, _, want = text.partition("@")
    if want and want != domain:
        return False
    if pattern == "*":
        return True
    if pattern.endswith(".*"):
        head = pattern[:-1]
        return event_type.startswith(head) and len(event_type) > len(head) and "." not in event_type[len(head) :]
    return bool(pattern) and event_type == pattern


FILTERS = ["*", "*@d1", "bus.a.*", "bus.a.b", "bus.a.b@d2", "bus.a_b.*", "bus.*", "bus.a.b.*", "", "@d1", "a.*", "bus.a.*@", "bus.a.*@d1"]
TYPES = ["bus.a.b", "bus.a.c", "bus.a.b.c", "bus.axb.c", "bus.a_b.c", "bus.a", "bus", "bus.a.", "Bus.a.b"]


def test_filters_match_the_naive_reading(spark):
    pairs = [(t, d) for t in TYPES for d in ("d1", "d2")]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(pairs)], "event_id long, event_type string, domain string")
    for f in FILTERS:
        assert {(r.event_type, r.domain) for r in rows.where(matches(f)).collect()} == {(t, d) for t, d in pairs if naive(t, d, f)}, f
    subs = spark.createDataFrame([(f"c{i}", f, 0) for i, f in enumerate(FILTERS)], "cursor_id string, event_type_filter string, last_event_id long")
    got = sorted((r.cursor_id, r.event_id) for r in fanout.fan_out(rows.withColumn("event_id", F.col("event_id") + 1), subs).collect())
    assert got == sorted((f"c{i}", k + 1) for i, f in enumerate(FILTERS) for k, (t, d) in enumerate(pairs) if naive(t, d, f))
    read = subs.select("event_type_filter", parsed(F.col("event_type_filter")).alias("p")).collect()
    assert all((r.p.kind, r.p.domain) == (parse(r.event_type_filter).kind, parse(r.event_type_filter).domain) for r in read)
    assert len(spark.range(1).select(event_keys(F.lit("x")).alias("k")).first().k) == 3


def test_polls_are_pushed_down(spark, tmp_path):
    log(spark, range(1, 30)).write.parquet(str(tmp_path / "e"))
    rows = poll.poll(spark.read.parquet(str(tmp_path / "e")), 5, "bus.test.*", 0)
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "GreaterThan(event_id,5)" in plan and "StringStartsWith(event_type,bus.test.)" in plan and "TakeOrderedAndProject" in plan


def test_poll_order_batch_and_expiry(spark):
    rows = log(spark, [3, 1, 2, 5, 4]).unionByName(log(spark, [6], expires_at=10))
    assert ids(poll.poll(rows, 1, "*", 1000, 3)) == [2, 3, 4]
    assert ids(poll.poll(rows, 4, "*", 1000)) == [5]
    assert ids(poll.poll(rows, 0, "bus.other.*", 1000)) == []


def test_cursor_behind_at_the_boundary(spark):
    rows = log(spark, range(100, 111))
    poll.check_cursor(rows, 99)
    poll.check_cursor(rows.limit(0), 0)
    with pytest.raises(BusError) as e:
        poll.check_cursor(rows, 98)
    assert e.value.code == "WB-003" and e.value.context["oldest_event_id"] == 100


CURSOR = "cursor_id string, subscription_id string, last_event_id long, acked_at long, created_at long, deregistered_at long"


def test_ack_and_replay(spark):
    c = spark.createDataFrame([("a", "s", 50, None, 1, None), ("b", "s", 7, 3, 1, None)], CURSOR)
    assert [(r.last_event_id, r.acked_at) for r in poll.ack(c, "a", 10, 99).orderBy("cursor_id").collect()] == [(10, 99), (7, 3)]
    acks = spark.createDataFrame([("a", 10), ("b", 9), ("b", 8)], "cursor_id string, event_id long")
    assert [(r.last_event_id) for r in poll.ack_forward(c, acks, 99).orderBy("cursor_id").collect()] == [50, 9]
    rows = log(spark, range(5, 60))
    back = poll.replay(c, rows, "a", 20)
    assert [(r.last_event_id, r.acked_at) for r in back.orderBy("cursor_id").collect()] == [(19, None), (7, 3)]
    with pytest.raises(BusError, match="WB-003"):
        poll.replay(c, rows, "a", 4)
    with pytest.raises(BusError, match="WB-006"):
        poll.replay(c, rows, "nobody", 20)


@pytest.mark.parametrize(
    ("warm", "live", "cursor", "batch", "want"),
    [
        (range(1, 51), [], 0, 100, list(range(1, 51))),
        ([], [], 0, 100, []),
        (range(1, 61), range(61, 101), 50, 100, list(range(51, 101))),
        (range(1, 51), range(51, 101), 25, 100, list(range(26, 101))),
        (range(1, 51), range(51, 101), 0, 10, list(range(1, 11))),
    ],
)
def test_tiers(spark, warm, live, cursor, batch, want):
    assert ids(poll.poll_tiered(log(spark, live), log(spark, warm), cursor, batch=batch)) == want


def test_live_rows_win(spark):
    rows = poll.poll_tiered(log(spark, range(5, 11), payload="LIVE"), log(spark, range(1, 11)), 0).collect()
    assert [r.event_id for r in rows] == list(range(1, 11)) and [r.event_id for r in rows if r.payload == "LIVE"] == list(range(5, 11))


def test_covering_buckets(spark):
    m = spark.createDataFrame([("a", 1, 50, 0, 1), ("b", 51, 60, 0, None), ("c", None, None, 0, None), ("d", 70, 90, 0, 1)], "bucket string, min_event_id long, max_event_id long, created_at long, sealed_at long")
    assert [r.bucket for r in poll.covering(m, 40, 45).collect()] == ["a"]
    assert [r.bucket for r in poll.covering(m, 65, 75).orderBy("bucket").collect()] == ["b", "d"]


def test_gaps(spark):
    have = [i for i in range(1, 400) if i not in (50, 51, 128, 256, 300)]
    got = sorted((r.after, r.before) for r in poll.gaps(log(spark, have), 64).collect())
    assert got == [(49, 52), (127, 129), (255, 257), (299, 301)]


def test_validation_codes_in_order(spark):
    rows = [
        (None, "d", "{}", None, None), ("bus.a", "", "{}", None, None), ("bus.a", "d", None, None, None), ("other.a", "d", "{}", None, None), ("bus." + "x" * 130, "d", "{}", None, None),
        ("bus.a", "d" * 65, "{}", None, None), ("bus.a", "d", "{}", "s" * 65, None), ("bus.a", "d", "[1]", None, None), ("bus.a", "d", "nope", None, None), ("bus.a", "d", '{"k":"' + "x" * 100 + '"}', None, None),
        ("bus.a", "d", "{}", None, "1.0"), ("bus.a", "d", "{}", None, "2.0.0"), ("bus.a", "d", "{}", "", "1.9.9"), ("bus.a_1.b2", "d", '{"a": 1}', None, None),
    ]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, event_type string, domain string, payload string, subdomain string, schema_version string")
    got = validate(d, Config(max_payload_bytes=64)).orderBy("ordinal").collect()
    assert [r.error_code for r in got] == ["WB-001"] * 11 + ["WB-005", None, None]
    assert [r.violation for r in got[:8]] == ["missing required fields"] * 3 + ["event_type does not match the pattern", "event_type exceeds 128 chars", "domain exceeds 64 chars", "subdomain exceeds 64 chars", "payload must be a valid JSON object"]


def test_config():
    assert Config.load("{broken").ttl_hours == 72
    assert Config.load('{"ttl_hours": 48, "dedup_ttl_hours": 12, "junk": 1}', archive_mode=True) == Config(ttl_hours=48, dedup_ttl_hours=12, archive_mode=True)
    with pytest.raises(BusError):
        Config(ttl_hours=1)


SCHEMAS = {
    "event_type": "bus.a",
    "schema": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1, "maximum": 5}, "s": {"type": ["string", "null"], "minLength": 2, "maxLength": 3}, "e": {"enum": ["p", "q"]}, "l": {"type": "array", "items": {"type": "number"}}, "o": {"type": "object", "required": ["z"]}}, "additionalProperties": False},
}


def test_json_schema_subset(spark):
    cases = {
        '{"x": 3}': [],
        '{"x": 3.0}': [],
        '{"x": 3.5}': ["x: expected integer"],
        "{}": ["<root>: missing x"],
        "[1]": ["<root>: expected object"],
        '{"x": 9, "s": "a"}': ["x: more than 5", "s: shorter than 2"],
        '{"x": 0, "s": null, "e": "r"}': ["x: less than 1", "e: not in enum"],
        '{"x": 1, "l": [1, "b", true]}': ["l[1]: expected number", "l[2]: expected number"],
        '{"x": 1, "o": {}, "y": 2}': ["o: missing z", "<root>: unexpected y"],
    }
    d = spark.createDataFrame([(k,) for k in cases], "payload string")
    got = {r.payload: r.v for r in d.withColumn("v", violations(SCHEMAS["schema"], F.try_parse_json("payload"))).collect()}
    assert got == cases


def test_emit_batch(spark):
    registry = spark.createDataFrame([("bus.a", 1, "{}", 16384, "warn"), ("bus.a", 2, json.dumps(SCHEMAS["schema"]), 16384, "warn"), ("bus.big", 1, "{}", 8, "strict"), ("bus.cas", 1, '{"required": ["k"]}', 8, "cas-auto"), ("bus.odd", 1, "{oops", 100, "warn")], "event_type string, version int, json_schema string, payload_max_bytes int, payload_oversize string")
    batch = spark.createDataFrame(
        [(1, "bus.a", "d", '{"x": 3}', "k1", "c"), (2, "bus.a", "d", '{"y": 3}', "k2", "c"), (3, "bus.a", "d", '{"x": 4}', "k1", "c"), (4, "bus.big", "d", '{"k": "long"}', "k4", None), (5, "bus.cas", "d", '{"k": "long"}', "k5", None), (6, "nope", "d", "{}", "k6", None), (7, "bus.odd", "d", "{}", "old", None), (8, "bus.odd", "d", "{}", "k8", "c")],
        "ordinal int, event_type string, domain string, payload string, idempotency_key string, correlation_id string",
    )
    known = log(spark, [41], idempotency_key="old")
    accepted, rejected = emit.emit_batch(batch, known, registry, 1_000_000, 41, Config())
    rows = accepted.orderBy("ordinal").collect()
    assert [(r.ordinal, r.event_id) for r in rows] == [(1, 42), (2, 43), (5, 44), (8, 45)]
    assert {r.ordinal: r.error_code for r in rejected.collect()} == {3: "WB-002", 4: "WB-008", 6: "WB-001", 7: "WB-002"}
    assert [r.parent_event_id for r in rows] == [None, 42, None, 43]
    assert rows[0].registry_schema_version == 2 and rows[0].expires_at == 1_000_000 + 72 * 3_600_000 and rows[0].dedup_expires_at == 1_000_000 + 24 * 3_600_000
    assert rows[2].payload == '{"$cas":"' + rows[2].payload_cas_sha + '"}'
    checked = {r.ordinal: r.warnings for r in emit.apply_registry(batch, registry).collect()}
    assert checked[1] == [] and "missing x" in checked[2][0] and "offloaded" in checked[5][0] and "missing k" in checked[5][1] and "unparseable" in checked[8][0]


def test_ids_follow_the_order_across_ranges(spark):
    r = random.Random(1)
    values = r.sample(range(10**6), 3000)
    got = emit.assign_ids(spark.createDataFrame([(v,) for v in values], "ordinal long"), 10, parts=16).orderBy("ordinal").collect()
    assert [x.event_id for x in got] == list(range(11, 3011))
    assert emit.assign_ids(spark.createDataFrame([], "ordinal long"), 10).count() == 0


def test_explicit_null_wins(spark):
    got = spark.createDataFrame([(True, None, "ctx"), (False, None, "ctx"), (True, "x", "ctx")], "p boolean, v string, c string").select(emit.chosen(F.col("p"), F.col("v"), F.col("c")).alias("o")).collect()
    assert [r.o for r in got] == [None, "ctx", "x"]


def test_control(spark):
    s1, c1 = control.register(spark, "p", "*", 10, 77, ids=("s1", "c1"))
    s2, c2 = control.register(spark, "p", "*", 20, 77, cursor_init="oldest", ids=("s2", "c2"))
    s3, c3 = control.register(spark, "q", "bus.a, bus.b", 5, 77, role="provider", ids=("s3", "c3"))
    subs, curs = s1.unionByName(s2).unionByName(s3), c1.unionByName(c2).unionByName(c3)
    assert {r.cursor_id: r.last_event_id for r in curs.collect()} == {"c1": 77, "c2": 0}
    assert control.resume(subs, curs, "p", "*").first().cursor_id == "c2"
    with pytest.raises(BusError):
        control.resume_only(subs, curs, "p", "*")
    assert control.resume_only(subs, curs, "p", "x") is None
    subs, curs = control.deregister(subs, curs, "s2", 99)
    assert control.resume_only(subs, curs, "p", "*").cursor_id == "c1"
    assert [r.subscription_id for r in control.list_subscriptions(subs).collect()] == ["s1", "s3"]
    assert len(control.list_subscriptions(subs, include_deregistered=True).collect()) == 3
    with pytest.raises(BusError, match="WB-006"):
        control.deregister(subs, curs, "s2", 100)
    changes = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 3, 1)], "cursor_id string, last_event_id long, seq long")
    assert {r.cursor_id: r.last_event_id for r in control.fold(changes, "cursor_id").collect()} == {"a": 5, "b": 3}


def test_dead_letters(spark):
    d = spark.createDataFrame([(1, "c", "s", 4, None, 10), (2, "c", "s", 4, None, 11), (3, "c", "s", 4, None, None)], "dl_id long, cursor_id string, subscription_id string, attempts int, last_error string, replay_requested_at long")
    tried = []

    def handler(row):
        tried.append(row["dl_id"])
        if row["dl_id"] == 2:
            raise ValueError("again")

    left = {r.dl_id: r for r in dlq.drain_replays(d, handler).collect()}
    assert tried == [1, 2] and set(left) == {2, 3} and left[2].attempts == 5 and left[2].replay_requested_at is None and left[2].last_error == "again"
    assert dlq.request_replay(d, 3, 50).where("dl_id = 3").first().replay_requested_at == 50
    assert dlq.drop(d, 3).count() == 2
    with pytest.raises(BusError, match="WB-006"):
        dlq.drop(d, 9)
    waits = spark.createDataFrame([(1,), (2,), (9,)], "attempts int").select(dlq.backoff_ms(F.col("attempts"), [5, 7]).alias("w")).collect()
    assert [r.w for r in waits] == [5, 7, 7]


def test_cas(spark):
    put, bad = cas.put(spark.createDataFrame([("a",), ("a",), ("toolong",), (None,)], "content string"), None, 1000, 4)
    assert [(r.size, r.content) for r in put.collect()] == [(1, "a")] and bad.first().error_code == "WB-008"
    assert cas.put(spark.createDataFrame([("a",)], "content string"), put, 1000)[0].count() == 0
    store = spark.createDataFrame([("x", 5, 0), ("y", 7, 900_000_000), ("z", 9, 0)], "sha string, size long, mtime long")
    live = cas.referenced(log(spark, [1], payload_cas_sha="x"), log(spark, [2], payload_cas_sha="x"))
    r = cas.gc_summary(store, live, 1_000_000_000).first()
    assert (r.live_shas, r.considered, r.deleted, r.skipped_in_grace, r.bytes_freed) == (1, 3, 1, 1, 9)
    cas.require_buckets({"a", "b"}, {"a"}, {"b"})
    with pytest.raises(BusError, match="WB-010"):
        cas.require_buckets({"a", "b"}, {"a"})


def test_lag_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, 1000 + i * 10, r.choice([500, 10_000])) for i in range(1, 60)]
    events = spark.createDataFrame(rows, "event_id long, emitted_at long, expires_at long")
    marks = [("a", 0), ("b", 30), ("c", 30), ("d", 59), ("e", 500)]
    curs = spark.createDataFrame(marks, "cursor_id string, last_event_id long")
    dead = spark.createDataFrame([("b",), ("b",)], "cursor_id string")
    for step in (7, 1 << 16):
        got = {x.cursor_id: tuple(x)[1:] for x in inspect.cursor_lag(curs, events, dead, 5000, step).collect()}
        for c, m in marks:
            unseen = [at for i, at, ex in rows if i > m and ex > 5000]
            assert got[c] == (max(0, 59 - m), 5000 - min(unseen) if unseen else None, 2 if c == "b" else 0)


def test_trace_tree(spark):
    rows = log(spark, range(1, 160), correlation_id="c").withColumn("parent_event_id", F.when(F.col("event_id") > 1, F.col("event_id") - 1))
    assert inspect.trace_tree(rows, "c").agg(F.max("depth")).first()[0] == 158


def test_trace_tree_of_any_depth(spark):
    chain = log(spark, range(1, 2501), correlation_id="c").withColumn("parent_event_id", F.when(F.col("event_id") > 1, F.col("event_id") - 1))
    assert {(r.event_id, r.depth) for r in inspect.trace_tree(chain, "c").collect()} == {(i, i - 1) for i in range(1, 2501)}
    parents = {1: None, 2: 1, 3: 1, 4: 3, 5: 99, 6: 5, 7: 8, 8: 7, 9: 9, 10: 7}  # 99 is outside; 7 and 8, and 9, are circles
    rows = spark.createDataFrame([("c", i, p) for i, p in parents.items()], "correlation_id string, event_id long, parent_event_id long")
    assert {tuple(r) for r in inspect.trace_tree(rows, "c").collect()} == {(1, None, 0), (2, 1, 1), (3, 1, 1), (4, 3, 2), (5, 99, 0), (6, 5, 1)}
    assert inspect.trace_tree(rows, "none").count() == 0


def test_choose_bucket():
    row = lambda b, sealed=None, size=0: {"bucket": b, "sealed_at": sealed, "bytes": size}
    assert sweep.choose_bucket("2026-04", []) == ("2026-04", None)
    assert sweep.choose_bucket("2026-04", [row("2026-04")]) == ("2026-04", None)
    assert sweep.choose_bucket("2026-04", [row("2026-04", size=5)], 5) == ("2026-04a", "2026-04")
    assert sweep.choose_bucket("2026-04", [row("2026-04", 1), row("2026-04a", 1)]) == ("2026-04b", None)
    with pytest.raises(BusError):
        sweep.next_suffix("2026-04z")
    assert sweep.bloat(5, 5, 4) == "WB-012" and sweep.bloat(1, 1) is None


def batch_of(spark, n, start=1, **more):
    rows = [{"ordinal": start + i, "event_type": "bus.test.fired", "domain": "d", "payload": json.dumps({"n": start + i}), "idempotency_key": f"k{start + i}"} | more for i in range(n)]
    return spark.createDataFrame(rows, "ordinal int, event_type string, domain string, payload string, idempotency_key string")


def test_store_lifecycle(spark, tmp_path):
    s = EventStore(spark, f"file://{tmp_path}/store")
    for k, at in enumerate((APRIL, MAY, JUNE)):
        accepted, rejected = s.emit(batch_of(spark, 4, 1 + 4 * k), at)
        assert accepted.count() == 4 and rejected.count() == 0
    assert {r.error_code for r in s.emit(batch_of(spark, 1), JUNE)[1].collect()} == {"WB-002"}
    assert ids(s.poll(0, "bus.test.*", APRIL, 5)) == [1, 2, 3, 4, 5]
    assert s.sweep(JUNE, stop_after_warm=True)["moved"] == 0  # a crash between the two commits
    assert ids(s.poll_tiered(0)) == list(range(1, 13))
    done = s.sweep(JUNE)
    assert done["moved"] == 8 and done["buckets"] == ["2026-04", "2026-05"]
    assert ids(s.poll_tiered(0)) == list(range(1, 13)) and ids(s.live().orderBy("event_id")) == [9, 10, 11, 12]
    with pytest.raises(BusError, match="WB-003"):
        s.poll(0, "*", JUNE)
    s.sweep(JUNE + 10**9, bucket_bytes=1)
    assert sorted(r.bucket for r in s.manifest().collect()) == ["2026-04", "2026-05", "2026-06"]
    assert s.live().count() == 0 and s.state()["high_water"] == 12
    accepted, _ = s.emit(batch_of(spark, 1), JUNE + 2 * 10**9)  # the key is free after its sweep
    assert ids(accepted) == [13] and ids(s.poll_tiered(4, batch=20)) == list(range(5, 14))
    assert EventStore(spark, f"file://{tmp_path}/store").state()["high_water"] == 13


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "live")
    log(spark, range(1, 9), domain="d1").write.mode("append").parquet(folder)
    log(spark, [9, 10], domain="d2", idempotency_key="evt-1").write.mode("append").parquet(folder)
    seen = []
    events = delivery.event_stream(spark, folder)
    delivery.start(delivery.subscription(events, "*@d1"), str(tmp_path / "c1"), lambda d, _: seen.extend(ids(d))).awaitTermination(120)
    assert sorted(seen) == list(range(1, 9))
    log(spark, [11], domain="d1").write.mode("append").parquet(folder)
    delivery.start(delivery.subscription(events, "*@d1"), str(tmp_path / "c1"), lambda d, _: seen.extend(ids(d))).awaitTermination(120)
    assert sorted(seen) == [*range(1, 9), 11]
    kept = []
    delivery.start(delivery.deduplicated(events), str(tmp_path / "c2"), lambda d, _: kept.extend(r.idempotency_key for r in d.collect())).awaitTermination(120)
    assert sorted(kept) == sorted(f"evt-{i}" for i in [*range(1, 9), 11])
    subs = spark.createDataFrame([("a", "*@d2", 9), ("b", "bus.test.*", 7)], "cursor_id string, event_type_filter string, last_event_id long")
    sent = []
    delivery.start(delivery.pushed(events, subs), str(tmp_path / "c3"), lambda d, _: sent.extend((r.cursor_id, r.event_id) for r in d.collect())).awaitTermination(120)
    assert sorted(sent) == [("a", 10), ("b", 8), ("b", 9), ("b", 10), ("b", 11)]


def test_retries_and_dead_letters(spark, tmp_path):
    folder = str(tmp_path / "live")
    log(spark, range(1, 6)).write.parquet(folder)

    def handler(row):
        if row["event_id"] == 3:
            raise ValueError("no")

    notices = delivery.event_stream(spark, folder).select(F.lit("c").alias("cursor_id"), "event_id", "payload")
    got = []
    delivery.start(delivery.delivered(notices, handler, 2), str(tmp_path / "c"), lambda d, _: got.extend(tuple(r) for r in d.collect())).awaitTermination(180)
    assert sorted(got) == [("c", i, "dead_letter" if i == 3 else "delivered", 3 if i == 3 else 1, "no" if i == 3 else None) for i in range(1, 6)]


def test_every_query_has_an_oracle():
    import __spark_entry__ as entry

    from tidelog.plans.queries import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


def test_causality_context(monkeypatch):
    from tidelog.functions import causality

    with causality.causing(correlation_id="c", session_id="s"):
        assert causality.stamped({"event_type": "x", "session_id": None}) == {"event_type": "x", "correlation_id": "c", "session_id": None}
        causality.emitted(5)
        with causality.causing(correlation_id="inner"):
            assert causality.current() == {"correlation_id": "inner", "session_id": "s", "parent_event_id": 5}
        assert causality.environment()["TIDELOG_PARENT_EVENT_ID"] == "5"
    assert causality.current() == {}
    monkeypatch.setenv("TIDELOG_CORRELATION_ID", "from outside")
    assert causality.current() == {"correlation_id": "from outside"}
    with pytest.raises(ValueError):
        causality.causing(nothing=1).__enter__()


def test_versions_and_large_scans(spark):
    from tidelog.operators import evolve

    old = spark.createDataFrame([(1, "bus.a", "d", "{}")], "event_id long, event_type string, domain string, payload string")
    rows = evolve.united(old, log(spark, [2], session_id="s")).orderBy("event_id").collect()
    assert [(r.event_id, r.subdomain, r.schema_version, r.session_id) for r in rows] == [(1, "", "1.0.0", None), (2, "", "1.0.0", "s")]
    evolve.check_scan(12, 0)
    with pytest.raises(BusError, match="WB-007"):
        evolve.check_scan(13, 0)


def test_files(spark, tmp_path):
    import hashlib

    from tidelog.sources import files

    good, bad = hashlib.sha256(b"abc").hexdigest(), "0" * 64
    for name, content in ((good, b"abc"), (bad, b"x"), ("other.txt", b"y")):
        (tmp_path / "cas" / name[:2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "cas" / name[:2] / name).write_bytes(content)
    rows = files.stored_objects(spark, str(tmp_path / "cas"), contents=True)
    assert {(r["sha"], r["size"]) for r in rows.collect()} == {(good, 3), (bad, 1)}
    assert [r.sha for r in files.corrupt_objects(rows).collect()] == [bad]
    (tmp_path / "p.json").write_text('{"a": 1}\n')
    assert files.payload_files(spark, str(tmp_path / "p.json")).first().payload == '{"a": 1}'
    subs = spark.createDataFrame([("s", "p", "provider", "bus.a, bus.b", 1, None), ("t", "q", "subscriber", "*", 1, None)], "subscription_id string, plugin string, role string, event_type_filter string, registered_at long, deregistered_at long")
    assert [(r.plugin, r.provides) for r in files.provider_manifest(subs).collect()] == [("p", ["bus.a", "bus.b"])]


def test_degrade_after_a_held_run(spark):
    samples = [("a", t * 10_000, d) for t, d in enumerate([250, 250, 10, 200, 200, 200, 200, 200])] + [("b", t * 10_000, 250 if t % 2 else 0) for t in range(8)]
    got = fanout.degrade_points(spark.createDataFrame(samples, "cursor_id string, at long, depth long")).collect()
    assert [(r.cursor_id, r.degraded_at) for r in got] == [("a", 60_000)]


def test_stream_windows_and_sessions(spark, tmp_path):
    folder = str(tmp_path / "live")
    log(spark, range(1, 11)).withColumn("emitted_at", F.lit(APRIL) + F.col("event_id") * 600_000).withColumn("correlation_id", F.lit("u")).write.parquet(folder)
    counts, runs = [], []
    query = delivery.counts_per_window(delivery.event_stream(spark, folder)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "w")).foreachBatch(lambda d, _: counts.extend(r.n for r in d.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(counts) == [5, 5]
    query = delivery.sessions(delivery.event_stream(spark, folder)).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "s")).foreachBatch(lambda d, _: runs.extend(r.n for r in d.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert runs in ([], [10])  # a session is complete once the watermark has passed it


def test_large_batch_of_the_oldest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sweep, "TOP_ROWS", 3)
    every = [*range(0, 4000, 2), -(1 << 63), (1 << 63) - 1, -7, 10**15]
    rows = spark.createDataFrame([(x,) for x in every], "event_id long").repartition(5)
    for n in (4, 5, 1000, 2002, 2003, 2004, 2005, (1 << 31) - 1):
        assert ids(sweep.oldest(rows, n).orderBy("event_id")) == sorted(every)[:n]
    assert ids(sweep.oldest(rows, 2)) == sorted(every)[:2] and ids(sweep.oldest(rows.limit(0), 9)) == []
    tied = spark.createDataFrame([(None,), (5,), (5,), (5,), (5,), (9,), (2,)], "event_id long")
    assert sorted(map(str, ids(sweep.oldest(tied, 5)))) == ["2", "5", "5", "5", "None"]
    assert sorted(map(str, ids(sweep.oldest(tied, 6)))) == ["2", "5", "5", "5", "5", "None"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweeps_and_emissions_of_whole_logs_stay_dealt_out(spark, tmp_path):
    log(spark, range(1, 41), dedup_expires_at=5).write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    for batch in (sweep.TOP_ROWS + 1, (1 << 31) - 1):
        plan = plan_of(sweep.candidates(stored, 10, batch))
        assert "SinglePartition" not in plan and "Limit" not in plan and "TakeOrdered" not in plan
    assert sweep.candidates(stored, 10, (1 << 31) - 1).count() == 40 and sweep.candidates(stored, 10, 7).count() == 7
    for half in emit.split_known(stored.select("idempotency_key"), stored):
        assert "Broadcast" not in plan_of(half)
