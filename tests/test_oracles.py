"""A few registered queries against their DuckDB oracles on the smallest tables, where those are there."""

import os

import pytest

from tidelog.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["poll_wildcard", "tiered_poll", "cursor_lag", "fanout_all", "payload_policy", "id_assign", "gap_check", "trace_tree", "cas_gc"])
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
