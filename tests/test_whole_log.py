"""The emission, acknowledgement and payload queries over every event, against their DuckDB oracles."""

import os

import pytest

from tidelog.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"  # 10,000 events: more than the prefixes that the older queries read


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["emit_dedup", "emit_duplicates", "id_assign", "ack_many", "cas_missing", "emit_accepted", "emit_rejected", "store_life", "ack_cursor", "poll_by_cursor", "deregistered", "dlq_drained", "cas_get", "managed_batch", "emit_dedup_all", "emit_duplicates_all", "id_assign_all", "ack_many_all", "cas_missing_all"])
def test_whole_log(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("events", "documents"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    n = db.sql("SELECT count(*) FROM events").fetchall()[0][0]
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    key = lambda r: [(v is None, str(v)) for v in r]
    rows = sorted(map(tuple, got.collect()), key=key)
    assert rows == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
    at = {c: i for i, c in enumerate(got.columns)}
    if name == "id_assign_all":
        assert len(rows) == n
    if name == "emit_duplicates_all":
        assert max(r[at["ordinal"]] for r in rows) > n - 700
    if name == "ack_many_all":
        assert max(r[at["last_event_id"]] for r in rows if r[at["cursor_id"]] in ("c1", "c2", "c3", "c4", "c5", "c6")) == n
