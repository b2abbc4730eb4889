"""Schemas, fixed sets, and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import types as T

LEVELS = ("debug", "info", "warn", "error")
#: Widths of count buckets, in seconds.
BUCKETS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}
GROUPS = ("service", "level")
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
MAX_SERVICE_CHARS = 255
MAX_BIGINT = 2**63 - 1
# Upper edges of histograms of times, in milliseconds; one more slot has no edge.
EDGES = (5, 10, 20, 40, 80, 160, 320)

#: Timestamps are UTC instants without a zone, to the microsecond.
LOGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("attributes", T.StringType(), False),
    ]
)
DELTA = "bucket_start timestamp_ntz, service string, level string, entry_count bigint"
TOKENS = "id bigint, ts timestamp_ntz, tokens array<bigint>"


class BadRequest(ValueError):
    """What a caller asked for isn't valid; the text says why."""


@dataclass(frozen=True)
class Settings:
    retention_days: int = 90
    rollup_width: int = 10
    rollup_lag_seconds: int = 5
    max_fold_rows: int = 2_000_000
    max_write_rows: int = 20_000
    fold_seconds: int = 2
    index_seconds: int = 1
    index_min_rows: int = 200
    index_max_rows: int = 200_000
    index_target_ms: int = 40
    index_max_ms: int = 120
    bounded_slots: int = 2
    scan_slots: int = 1
    compact_deltas: int = 64

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
                raise ValueError(f"{f.name} must be a positive integer, not {value!r}")
        if 60 % self.rollup_width:
            raise ValueError("rollup_width must divide 60")
        if not self.index_min_rows <= self.index_max_rows or self.index_target_ms > self.index_max_ms:
            raise ValueError("index limits are out of order")

    @classmethod
    def from_env(cls, env=os.environ) -> "Settings":
        """LOGWEIR_<NAME> for each setting; what isn't a positive integer is refused."""
        found = {}
        for f in fields(cls):
            raw = env.get(f"LOGWEIR_{f.name.upper()}")
            if raw is not None:
                if not raw.strip().isdigit():
                    raise ValueError(f"LOGWEIR_{f.name.upper()} must be a positive integer, not {raw!r}")
                found[f.name] = int(raw)
        return cls(**found)
