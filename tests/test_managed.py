"""Managed subscriptions, the control log, and inputs that strict readers judge otherwise than lenient ones."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_engine import event, log
from tidelog.functions.jsonschema import violations
from tidelog.functions.validate import last_key_wins, validate
from tidelog.model import EVENT, BusError, Config
from tidelog.operators import control as controls
from tidelog.operators import dlq, emit, fanout, poll
from tidelog.sources.control_log import ControlLog
from tidelog.sources.files import scratch, write_sidecars
from tidelog.streaming.managed import SHUTDOWN, Subscriber, iterate


def subscribed(spark, path, filter_text="bus.test.*"):
    table = ControlLog(spark, str(path))
    sub, cur = controls.register(spark, "p", filter_text, 1, 0, cursor_init="oldest", ids=("s", "c"))
    table.put("subscriptions", sub)
    table.put("cursors", cur)
    return table


def test_a_managed_subscription(spark, tmp_path):
    table = subscribed(spark, tmp_path)
    rows = log(spark, [1, 2, 3], expires_at=10_000).unionByName(log(spark, [4], event_type="bus.other", expires_at=10_000)).cache()
    seen, errors, dead = [], [], []

    def handler(e):
        seen.append(e["event_id"])
        if e["event_id"] == 2:
            raise ValueError("no twos")

    make = lambda **more: Subscriber(table, lambda: rows, "c", more.pop("handler", handler), max_retries=2, backoff_ms=(0,), clock=lambda: 100, on_error=lambda e, x: errors.append(str(e)), on_dead_letter=lambda x, why: dead.append((x["event_id"], why)), **more)
    assert make().tick() == 3
    assert seen == [1, 2, 2, 2, 3] and dead == [(2, "no twos")] and errors == ["no twos"] * 3
    assert poll.cursor_row(table.read("cursors"), "c")["last_event_id"] == 3 and table.read("attempts").isEmpty()
    letter = table.read("dead_letters").first()
    assert (letter.dl_id, letter.attempts, letter.last_error, letter.subscription_id) == (1, 3, "no twos", "s")
    assert make().lag() == make().lag() and make().lag()["dlq_count"] == 1
    # a replay is one try: failure unmarks it and counts, success removes the letter
    table.put("dead_letters", dlq.request_replay(table.read("dead_letters"), 1, 7))
    assert make().drain() == 0
    letter = table.read("dead_letters").first()
    assert (letter.attempts, letter.replay_requested_at) == (4, None)
    table.put("dead_letters", dlq.request_replay(table.read("dead_letters"), 1, 8))
    assert make(handler=lambda e: None).drain() == 1 and table.read("dead_letters").isEmpty()
    table.compact("cursors")
    assert poll.cursor_row(table.read("cursors"), "c")["last_event_id"] == 3


def test_restarts_resume_the_count_and_shutdown_dead_letters(spark, tmp_path):
    table = subscribed(spark, tmp_path)
    rows = log(spark, [1], expires_at=10_000)
    table.put_rows("attempts", [{"cursor_id": "c", "event_id": 1, "attempts": 2, "last_error": "before"}])
    tried = []

    def fails(e):
        tried.append(e["event_id"])
        raise ValueError("again")

    worker = Subscriber(table, lambda: rows, "c", fails, max_retries=2, backoff_ms=(0,), clock=lambda: 100)
    assert worker.tick() == 1 and tried == [1] and table.read("dead_letters").first().attempts == 3
    other = subscribed(spark, tmp_path / "other")
    ends = Subscriber(other, lambda: rows, "c", fails, max_retries=5, backoff_ms=(60_000,), clock=lambda: 100, on_error=lambda e, x: ends.stop())
    assert ends.tick() == 1
    assert other.read("dead_letters").first().last_error == SHUTDOWN and other.read("attempts").isEmpty()
    told = []
    lost = Subscriber(other, lambda: log(spark, [50], expires_at=10_000), "c", fails, clock=lambda: 100, on_error=lambda e, x: told.append(e.code))
    assert lost.tick() == 0 and told == ["WB-003"]


def test_cursors_by_id(spark, tmp_path):
    table = subscribed(spark, tmp_path)
    rows = log(spark, range(1, 6), expires_at=10_000)
    args = lambda: (rows, table.read("cursors"), table.read("subscriptions"))
    assert [r.event_id for r in poll.poll_cursor(*args(), "c", 100, 2).collect()] == [1, 2]
    with pytest.raises(BusError, match="WB-006"):
        poll.poll_cursor(*args(), "nobody", 100)
    with pytest.raises(BusError, match="WB-006"):
        poll.ack(table.read("cursors"), "nobody", 3, 9)
    assert [e["event_id"] for e in iterate(table, lambda: rows, "c", lambda: 100, 2)] == [1, 2, 3, 4, 5]
    again, new = controls.register_or_resume(table.read("subscriptions"), table.read("cursors"), "p", "bus.test.*", 5, 40)
    assert again == {"subscription_id": "s", "cursor_id": "c", "last_event_id": 5} and new is None
    first, new = controls.register_or_resume(table.read("subscriptions"), table.read("cursors"), "p", "*", 5, 40)
    assert first["last_event_id"] == 40 and new[0].first().plugin == "p"
    sub, cur = controls.deregister(table.read("subscriptions"), table.read("cursors"), "s", 9)
    with pytest.raises(BusError, match="WB-006"):
        poll.poll_cursor(rows, cur, sub, "c", 100)


def test_validation_reads_to_the_end_of_the_text(spark):
    cases = {1: ("bus.x", "1.0.0", "{}"), 2: ("bus.x\n", "1.0.0", "{}"), 3: ("bus.x", "1.0.0\n", "{}"), 4: ("bus.x", "99999999999.0.0", "{}"), 5: ("bus.x", "01.0.0", '{"a":1,"a":2}'), 6: ("bus.x", "2.0.0", "{}"), 7: ("bus.x", "00.1.0", '{"a":{"b":1,"b":2}}')}
    rows = spark.createDataFrame([(i, t, "d", "", p, v) for i, (t, v, p) in cases.items()], "event_id long, event_type string, domain string, subdomain string, payload string, schema_version string")
    got = {r.event_id: r.error_code for r in validate(rows, Config()).collect()}
    assert got == {1: None, 2: "WB-001", 3: "WB-001", 4: "WB-005", 5: None, 6: "WB-005", 7: None}


def test_schemas_compare_values_and_name_any_property(spark):
    last_key_wins(spark)
    schema = {"properties": {"e": {"enum": ["é", 1, {"b": 1, "a": [2]}, None, True]}, "it's": {"type": "integer"}, 'q"': {"maxLength": 1}}}
    payloads = ['{"e":"é"}', '{"e":1.0}', '{"e":{"a":[2],"b":1}}', '{"e":null}', '{"e":true}', '{"e":2}', '{"e":"1"}', '{"it\'s":"x"}', json.dumps({'q"': "long"}), '{"e":1e0}', '{"e":{"a":[2]}}']
    rows = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    got = {r.i: r.v for r in rows.select("i", violations(schema, F.try_parse_json("p")).alias("v")).collect()}
    assert [i for i in got if got[i]] == [5, 6, 7, 8, 10]
    assert got[5] == ["e: not in enum"] and got[7] == ["it's: expected integer"]


def test_events_without_a_context_have_no_parent(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "c") for i in range(1, 10)], "event_id long, correlation_id string")
    got = {r.event_id: r.parent_event_id for r in emit.chain_parents(rows).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: None, 6: 3, 7: None, 8: None, 9: 6}


def test_replays_are_applied_at_once(spark):
    letters = spark.createDataFrame([(i, 1, None, 5 if i != 3 else None) for i in range(1, 7)], "dl_id long, attempts int, last_error string, replay_requested_at long")

    def handler(x):
        if x["dl_id"] == 5:
            raise ValueError("five")

    got = {r.dl_id: (r.attempts, r.last_error, r.replay_requested_at) for r in dlq.drain_replays(letters, handler).collect()}
    assert got == {3: (1, None, None), 5: (2, "five", None), 6: (1, None, 5)}


def test_push_filters_and_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([event(1, subdomain="a"), event(2, subdomain="b")], EVENT)
    assert [r.event_id for r in rows.where(fanout.push_matches({"domain": "d", "subdomain": "b"})).collect()] == [2]
    assert rows.where(fanout.push_matches(None)).count() == 2
    subs = controls.register(spark, "pl", "bus.a.*, bus.b", 1, 0, role="provider", ids=("s", "c"))[0]
    write_sidecars(subs, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().provides == ["bus.a.*", "bus.b"]
    write_sidecars(subs.withColumn("deregistered_at", F.lit(5)), str(tmp_path / "m"))
    assert not [p for p in (tmp_path / "m").rglob("*.json")]


def test_scratch_needs_no_setting():
    from types import SimpleNamespace

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="local[4]"))
    assert scratch(bare, "x").startswith("file:///") and scratch(bare, "x") != scratch(bare, "x")
    bare.sparkContext.master = "yarn"
    with pytest.raises(RuntimeError):
        scratch(bare, "x")


def test_a_sweep_defers_what_it_cannot_read(spark, tmp_path):
    import glob

    from tests.test_engine import APRIL, JUNE, MAY
    from tidelog.sources import store as stores

    s = stores.EventStore(spark, f"file://{tmp_path}/store")
    rows = lambda a, b: spark.createDataFrame([(i, "bus.test.fired", "d", json.dumps({"n": i})) for i in range(a, b)], "ordinal long, event_type string, domain string, payload string")
    s.emit(rows(1, 4), APRIL)
    s.emit(rows(4, 7), MAY)
    assert s.sweep(MAY - 1)["moved"] == 3 and len(s.state()["live"]) == 2
    s.emit(rows(7, 9), APRIL + 1)
    untouched = s.state()["live"][1]
    bad = glob.glob(f"{tmp_path}/store/warm/*/2026-04/*.parquet")
    kept = {p: open(p, "rb").read() for p in bad}
    for p in bad:
        open(p, "wb").write(b"spoilt")
        crc = p.rsplit("/", 1)[0] + "/." + p.rsplit("/", 1)[1] + ".crc"
        if glob.glob(crc):
            import os

            os.remove(crc)
    done = s.sweep(MAY - 1)
    assert done["deferred"] == ["2026-04"] and done["moved"] == 0 and untouched in s.state()["live"]
    with pytest.raises(BusError, match="WB-013"):
        s.poll_tiered(0)
    done = s.sweep(JUNE)
    assert (done["moved"], done["buckets"], done["deferred"]) == (3, ["2026-05"], ["2026-04"])
    for p, raw in kept.items():
        open(p, "wb").write(raw)
    assert s.sweep(JUNE)["moved"] == 2
    assert [r.event_id for r in s.poll_tiered(0).collect()] == list(range(1, 9))
    (tmp_path / "store" / "lock").touch()
    with pytest.raises(BusError, match="WB-004"):
        s.sweep(JUNE)
    import os

    os.utime(tmp_path / "store" / "lock", (1, 1))
    assert s.sweep(JUNE)["moved"] == 0
