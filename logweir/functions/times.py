"""Instants as integer microseconds on the driver, and time expressions on columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
_EPOCH = datetime(1970, 1, 1)
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?\s*(?:([Zz])|([+-])(\d{2}):?(\d{2}))?)?$", re.ASCII)


def parse_iso(text: str) -> int | None:
    """Microseconds since the epoch of an ISO 8601 date or time, UTC if it has no zone; None if it isn't one. Digits beyond microseconds are cut."""
    m = _ISO.match(text) if isinstance(text, str) else None
    if not m:
        return None
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    try:
        at = datetime(year, month, day, hour, minute, second, int((m[7] or "0").ljust(6, "0")[:6]))
        if m[9]:
            offset = timedelta(hours=int(m[10]), minutes=int(m[11]))
            if offset >= timedelta(days=1):
                return None
            at = at.replace(tzinfo=timezone(offset if m[9] == "+" else -offset)).astimezone(UTC).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None
    return to_micros(at)


def to_micros(at: datetime) -> int:
    return (at - _EPOCH) // timedelta(microseconds=1)


def from_micros(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=us)


def iso(us: int) -> str:
    """With all six digits of the fraction, so that nothing is lost."""
    return from_micros(us).isoformat(timespec="microseconds") + "Z"


def floor_to(us: int, seconds: int) -> int:
    return us - us % (seconds * SECOND)


def ceil_to(us: int, seconds: int) -> int:
    return -(-us // (seconds * SECOND)) * (seconds * SECOND)


def at(us: int) -> Column:
    """A literal that compares with ts as it is, so that filters reach the scan."""
    return F.lit(from_micros(us).isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def time_bin(ts: Column, seconds: int) -> Column:
    """The start of the epoch-aligned bin. One call per select: the planner takes one set of windows at a time."""
    return F.window(ts, f"{seconds} seconds")["start"]


def bucket_label(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ, whatever the session's zone."""
    return F.concat(F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def page_label(ts: Column) -> Column:
    """As bucket_label, with milliseconds."""
    text = ts.cast("string")
    fraction = F.rpad(F.substring(F.coalesce(F.get(F.split(text, r"\."), F.lit(1)), F.lit("")), 1, 3), 3, "0")
    return F.concat(F.translate(F.substring(text, 1, 19), " ", "T"), F.lit("."), fraction, F.lit("Z"))


def week_start(ts: Column) -> Column:
    """The Monday of the ISO week."""
    return F.date_trunc("week", ts).cast("date")
