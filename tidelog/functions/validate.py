"""Event validation as ordered expressions: the first violation of each row, or all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Config

# Fixed patterns: versions, and those whose first part is 0 or 1. They end where the text ends, before no newline.
SEMVER = r"^\d+\.\d+\.\d+\z"
SUPPORTED = r"^0*[01]\."


def type_pattern(prefix: str) -> str:
    return rf"^{prefix}\.[a-z0-9_]+(\.[a-z0-9_]+)*\z"


def last_key_wins(spark: SparkSession) -> None:
    """JSON objects may repeat a key in this session; the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def is_object(payload: Column) -> Column:
    """Whether text is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def rules(config: Config) -> list[tuple[str, str, Column]]:
    """(code, violation, test), in the order in which the first counts."""
    # The codes, the texts and their order.
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    return [
        ("WB-001", "missing required fields", blank("event_type") | blank("domain") | c("payload").isNull()),
        ("WB-001", "event_type exceeds 128 chars", F.char_length("event_type") > 128),
        ("WB-001", "event_type does not match the pattern", ~c("event_type").rlike(type_pattern(config.type_prefix))),
        ("WB-001", "domain exceeds 64 chars", F.char_length("domain") > 64),
        ("WB-001", "subdomain exceeds 64 chars", F.char_length("subdomain") > 64),
        ("WB-001", "payload must be a valid JSON object", ~is_object(c("payload"))),
        ("WB-001", "payload exceeds max_payload_bytes", F.octet_length("payload") > config.max_payload_bytes),
        ("WB-001", "invalid schema_version format", ~c("schema_version").rlike(SEMVER)),
        ("WB-005", "schema_version is not supported", ~c("schema_version").rlike(SUPPORTED)),
    ]


def validate(events: DataFrame, config: Config) -> DataFrame:
    """Adds error_code and violation (null for valid rows) and all_violations."""
    last_key_wins(events.sparkSession)
    code = violation = None
    every = []
    for k, v, test in rules(config):
        hit = F.coalesce(test, F.lit(False))
        code = F.when(hit, k) if code is None else code.when(hit, k)
        violation = F.when(hit, v) if violation is None else violation.when(hit, v)
        every.append(F.when(hit, F.lit(v)))
    return events.withColumns({"error_code": code, "violation": violation, "all_violations": F.array_compact(F.array(*every))})
