"""Event schema, control-table schemas, error codes and configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

EVENT = (
    "event_id bigint, event_type string, domain string, subdomain string, payload string, schema_version string, "
    "idempotency_key string, emitted_at bigint, expires_at bigint, dedup_expires_at bigint, metadata string, "
    "parent_event_id bigint, session_id string, correlation_id string, producer_id string, origin_node_id string, "
    "registry_schema_version int, payload_cas_sha string"
)
EVENT_COLUMNS = [x.split()[0] for x in EVENT.split(", ")]
SUBSCRIPTION = "subscription_id string, plugin string, role string, event_type_filter string, schema_version string, registered_at bigint, deregistered_at bigint, health_check_interval_ms bigint"
CURSOR = "cursor_id string, subscription_id string, last_event_id bigint, acked_at bigint, created_at bigint, deregistered_at bigint, push_socket_addr string, lag_estimate bigint"
ATTEMPT = "cursor_id string, event_id bigint, attempts int, last_attempt_at bigint, last_error string"
DEAD_LETTER = "dl_id bigint, cursor_id string, subscription_id string, event_id bigint, event_type string, domain string, subdomain string, payload string, emitted_at bigint, attempts int, last_error string, dead_lettered_at bigint, replay_requested_at bigint"
SCHEMA = "event_type string, version int, json_schema string, retention string, payload_max_bytes int, archive_to string, payload_oversize string, deprecated_at bigint, sunset_at bigint"
MANIFEST = "bucket string, min_event_id bigint, max_event_id bigint, created_at bigint, sealed_at bigint, bytes bigint"

HOUR_MS = 3_600_000

# The error codes and their names.
ERRORS = {
    "WB-001": "INVALID_EVENT_SCHEMA",
    "WB-002": "DUPLICATE_EVENT",
    "WB-003": "CURSOR_BEHIND_TTL_WINDOW",
    "WB-004": "DISK_FULL",
    "WB-005": "SCHEMA_VERSION_UNSUPPORTED",
    "WB-006": "CURSOR_NOT_FOUND",
    "WB-007": "LARGE_SCAN_REJECTED",
    "WB-008": "PAYLOAD_TOO_LARGE",
    "WB-009": "SCHEMA_MISMATCH",
    "WB-010": "CAS_GC_INCOMPLETE_BUCKET_SET",
    "WB-011": "UI_TOKEN_PERMISSION_MISMATCH",
    "WB-012": "LIVE_TIER_BLOAT_WARNING",
    "WB-013": "SPILL_BUCKET_UNAVAILABLE",
}


class BusError(Exception):
    """An error of a single call, with its code and context."""

    def __init__(self, code: str, message: str = "", **context):
        super().__init__(f"{code} {ERRORS[code]}: {message}")
        self.code, self.name, self.context = code, ERRORS[code], context
        self.exit_code = int(code.removeprefix("WB-"))


@dataclass(frozen=True)
class Config:
    """Limits and timers; hours count from the time of emission."""

    ttl_hours: float = 72
    dedup_ttl_hours: float = 24
    sweep_interval_minutes: int = 15
    archive_mode: bool = False
    log_level: str = "warn"
    max_payload_bytes: int = 1_048_576
    type_prefix: str = "bus"

    def __post_init__(self):
        if self.ttl_hours < 0 or self.dedup_ttl_hours < 0 or self.sweep_interval_minutes < 0 or self.max_payload_bytes <= 0:
            raise BusError("WB-001", "limits must not be negative")
        if self.dedup_ttl_hours > self.ttl_hours:
            raise BusError("WB-001", "dedup_ttl_hours exceeds ttl_hours")

    @staticmethod
    def load(text: str | None = None, **overrides) -> Config:
        """Defaults, then a JSON file's fields (malformed text counts as none), then overrides."""
        import json

        try:
            found = json.loads(text) if text else {}
        except ValueError:
            found = {}
        known = {f.name for f in fields(Config)}
        return Config(**{k: v for k, v in ((found if isinstance(found, dict) else {}) | overrides).items() if k in known})

    def to_json(self) -> str:
        import json

        return json.dumps(asdict(self))
