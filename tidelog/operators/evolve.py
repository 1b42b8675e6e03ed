"""Rows of earlier schema versions, and reads that are too large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EVENT, EVENT_COLUMNS, BusError

MAX_BUCKETS = 12
MAX_BYTES = 5 << 30


def normalized(rows: DataFrame) -> DataFrame:
    """Any version's rows with all columns of today's: absent ones are null, subdomain and version have defaults."""
    types = dict(zip(EVENT_COLUMNS, (x.split()[1] for x in EVENT.split(", ")), strict=True))
    out = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in EVENT_COLUMNS])
    return out.withColumns({"subdomain": F.coalesce("subdomain", F.lit("")), "schema_version": F.coalesce("schema_version", F.lit("1.0.0"))})


def united(*versions: DataFrame) -> DataFrame:
    """Tables of several versions as one."""
    out = normalized(versions[0])
    for v in versions[1:]:
        out = out.unionByName(normalized(v))
    return out


def empty_events(spark) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(EVENT))


def check_scan(buckets: int, size: int, max_buckets: int = MAX_BUCKETS, max_bytes: int = MAX_BYTES) -> None:
    """WB-007 for a read over many buckets or bytes that nobody has allowed."""
    if buckets > max_buckets or size > max_bytes:
        raise BusError("WB-007", f"{buckets} buckets, {size} bytes", buckets=buckets, bytes=size)
