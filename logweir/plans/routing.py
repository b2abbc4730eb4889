"""Which counts come from the pre-aggregate, and which from rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import times
from ..model import BUCKETS, GROUPS, BadRequest
from .requests import common_filters, instant, one_of


@dataclass(frozen=True)
class AggregateRequest:
    since: int
    until: int
    bucket: str
    group_by: str | None = None
    service: str | None = None
    level: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    q: str | None = None

    @classmethod
    def parse(cls, params: dict) -> "AggregateRequest":
        since, until = instant(params, "since", True), instant(params, "until", True)
        if until < since:
            raise BadRequest("until must not be earlier than since")
        bucket = one_of(params, "bucket", BUCKETS, True)
        return cls(since=since, until=until, bucket=bucket, group_by=one_of(params, "group_by", GROUPS), **common_filters(params))

    @property
    def seconds(self) -> int:
        return BUCKETS[self.bucket]

    @property
    def cost(self) -> str:
        """scan if the rows' texts or attributes must be read, else bounded."""
        return "scan" if self.q is not None or self.attributes else "bounded"


@dataclass(frozen=True)
class RawRange:
    since: int
    until: int
    #: Only rows from this id on.
    min_id: int | None = None


@dataclass(frozen=True)
class Plan:
    path: str
    rollup: tuple[int, int] | None
    raw: tuple[RawRange, ...]


def plan(req: AggregateRequest, watermark: int | None, stored: int) -> Plan:
    """Whole stored buckets come from the pre-aggregate for rows below the watermark, everything else from rows.

    A row belongs to one side by its id alone, so that late rows are counted exactly. All range
    arithmetic is in microseconds: an edge within a stored bucket leaves a fragment to the rows.
    """
    raw = Plan("raw", None, (RawRange(req.since, req.until),))
    if req.cost == "scan" or not watermark or stored <= 0 or req.seconds < stored or req.seconds % stored:
        return raw
    low, high = times.ceil_to(req.since, stored), times.floor_to(req.until, stored)
    if low >= high:
        return raw
    ranges = [RawRange(low, high, watermark)]
    if req.since < low:
        ranges.insert(0, RawRange(req.since, low))
    if high < req.until:
        ranges.append(RawRange(high, req.until))
    return Plan("hybrid", (low, high), tuple(ranges))


def actual_path(rollup_rows: int, raw_rows: int) -> str:
    """By the rows that were touched; none at all is raw."""
    if rollup_rows and raw_rows:
        return "hybrid"
    return "rollup" if rollup_rows else "raw"
