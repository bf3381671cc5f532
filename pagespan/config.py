"""Settings from environment variables, with the same defaults and limits for every run."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

_UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


class ConfigError(ValueError):
    """A setting is missing or out of bounds."""


def duration_ms(text: str) -> float:
    """Milliseconds of a text like 1m30s."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+"):
        raise ConfigError(f"invalid duration {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


# Integer settings with default, least and most.
INTEGERS = {"WORKERS": (3, 1, 32), "URL_BATCH_SIZE": (100, 1, 10_000), "HTTP_MAX_RETRIES": (2, 0, 5), "DB_MAX_RETRIES": (2, 0, 5), "HEARTBEAT_FAILURE_THRESHOLD": (3, 1, 10), "REPORT_RETENTION_COUNT": (100, 1, 10_000), "MAX_CONCURRENT_PER_HOST": (1, 1, 16), "MAX_HTML_BODY_BYTES": (5 << 20, 1, 8 << 20), "MAX_HTML_TOKEN_BYTES": (512 << 10, 1, 1 << 20)}
# Durations with their default.
DURATIONS = {"HTTP_ATTEMPT_TIMEOUT": "5s", "HTTP_TOTAL_TIMEOUT": "20s", "ROBOTS_ATTEMPT_TIMEOUT": "3s", "ROBOTS_TOTAL_TIMEOUT": "10s", "DB_CONNECT_TIMEOUT": "5s", "DB_MIGRATION_TIMEOUT": "30s", "DB_FETCH_TIMEOUT": "5s", "DB_WRITE_TIMEOUT": "3s", "REPORT_EXPORT_TIMEOUT": "2m", "AUDIT_RUN_HEARTBEAT_INTERVAL": "30s", "STALE_RUN_THRESHOLD": "5m", "TARGET_LEASE_DURATION": "2m", "SHUTDOWN_TIMEOUT": "25s", "FINALIZATION_TIMEOUT": "30s", "STOP_GRACE_PERIOD": "65s", "RATE_LIMIT_INTERVAL": "500ms", "ROBOTS_CACHE_TTL": "1h", "RETRY_BASE_DELAY": "200ms", "RETRY_MAX_DELAY": "2s"}
# Pairs of which the first must not exceed the second, and pairs of which it must be lower.
AT_MOST = [("HTTP_ATTEMPT_TIMEOUT", "HTTP_TOTAL_TIMEOUT"), ("ROBOTS_ATTEMPT_TIMEOUT", "ROBOTS_TOTAL_TIMEOUT"), ("RETRY_BASE_DELAY", "RETRY_MAX_DELAY")]
LOWER = [("RATE_LIMIT_INTERVAL", "HTTP_TOTAL_TIMEOUT"), ("RATE_LIMIT_INTERVAL", "ROBOTS_TOTAL_TIMEOUT"), ("RETRY_MAX_DELAY", "HTTP_TOTAL_TIMEOUT"), ("RETRY_MAX_DELAY", "ROBOTS_TOTAL_TIMEOUT"), ("AUDIT_RUN_HEARTBEAT_INTERVAL", "STALE_RUN_THRESHOLD"), ("AUDIT_RUN_HEARTBEAT_INTERVAL", "TARGET_LEASE_DURATION")]
PARSER_BUDGET, PARSER_FACTOR = 96 << 20, 8


@dataclass(frozen=True)
class Config:
    """Integers and durations (in milliseconds) by name, and the texts."""

    values: dict[str, float]
    run_id: str
    worker_id: str
    fingerprint_key: bytes
    fingerprint_key_id: str
    log_level: str
    allow_private: bool

    def __getitem__(self, name: str):
        return self.values[name]


def load(env: Mapping[str, str] | None = None) -> Config:
    """Settings of env, by default the process's. Raises ConfigError naming what is wrong."""
    env = os.environ if env is None else env
    get = lambda k, default="": env.get(k, "").strip() or default
    v: dict[str, float] = {}
    for k, (default, least, most) in INTEGERS.items():
        try:
            v[k] = int(get(k, str(default)))
        except ValueError as e:
            raise ConfigError(f"{k} must be an integer") from e
        if not least <= v[k] <= most:
            raise ConfigError(f"{k} must be between {least} and {most}")
    for k, default in DURATIONS.items():
        v[k] = duration_ms(get(k, default))
        if v[k] <= 0:
            raise ConfigError(f"{k} must be positive")
    for a, b in AT_MOST:
        if v[a] > v[b]:
            raise ConfigError(f"{a} must not exceed {b}")
    for a, b in LOWER:
        if v[a] >= v[b]:
            raise ConfigError(f"{a} must be lower than {b}")
    if v["ROBOTS_CACHE_TTL"] > 24 * 3_600_000:
        raise ConfigError("ROBOTS_CACHE_TTL must not exceed 24h")
    if v["STOP_GRACE_PERIOD"] < v["SHUTDOWN_TIMEOUT"] + v["FINALIZATION_TIMEOUT"] + 5000:
        raise ConfigError("STOP_GRACE_PERIOD must leave time for shutdown and finalization")
    if v["WORKERS"] * min(v["MAX_HTML_BODY_BYTES"], v["MAX_HTML_TOKEN_BYTES"]) * PARSER_FACTOR > PARSER_BUDGET:
        raise ConfigError("WORKERS and MAX_HTML_TOKEN_BYTES exceed the parser's memory")
    run_id = get("RUN_ID", str(uuid.uuid4())).lower()
    if not re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", run_id):
        raise ConfigError("RUN_ID must be a UUID")
    key = get("TARGET_FINGERPRINT_KEY").encode()
    if len(key) < 32:
        raise ConfigError("TARGET_FINGERPRINT_KEY must have 32 bytes at least")
    key_id, worker = get("TARGET_FINGERPRINT_KEY_ID", "default"), get("WORKER_INSTANCE_ID", f"worker-{uuid.uuid4()}")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,31}", key_id) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}", worker):
        raise ConfigError("TARGET_FINGERPRINT_KEY_ID or WORKER_INSTANCE_ID has characters that aren't allowed")
    level = get("LOG_LEVEL", "info").lower()
    if level not in ("debug", "info", "warn", "warning", "error"):
        raise ConfigError("LOG_LEVEL is not known")
    private = get("ALLOW_PRIVATE_TARGETS", "false").lower()
    if private not in ("true", "false", "1", "0", "t", "f"):
        raise ConfigError("ALLOW_PRIVATE_TARGETS must be a boolean")
    return Config(v, run_id, worker, key, key_id, level, private in ("true", "1", "t"))
