"""Newest-first pages with keyset cursors."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import times
from ..functions.predicates import all_of, before_cursor, entry_filters, has_tokens, time_range
from ..model import DEFAULT_LIMIT, LOGS, MAX_BIGINT, MAX_LIMIT, BadRequest
from ..plans.requests import common_filters, instant, single


def newest_first() -> list:
    return [F.desc("ts"), F.desc("id")]


def encode_cursor(us: int, id_: int) -> str:
    """The instant to the microsecond: a cut one would skip rows of the same millisecond."""
    return base64.b64encode(json.dumps({"timestamp": times.iso(us), "id": str(id_)}, separators=(",", ":")).encode()).decode()


def decode_cursor(raw: str) -> tuple[int, int]:
    try:
        found = json.loads(base64.b64decode(raw, validate=True).decode())
        us, id_ = times.parse_iso(found["timestamp"]), found["id"]
        if us is None or not isinstance(id_, str) or not re.fullmatch(r"[0-9]+", id_) or int(id_) > MAX_BIGINT:
            raise ValueError
        return us, int(id_)
    except (binascii.Error, ValueError, KeyError, TypeError, UnicodeDecodeError) as e:
        raise BadRequest("cursor is invalid or malformed") from e


@dataclass(frozen=True)
class PageRequest:
    service: str | None = None
    level: str | None = None
    since: int | None = None
    until: int | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    q: str | None = None
    limit: int = DEFAULT_LIMIT
    cursor: tuple[int, int] | None = None

    @classmethod
    def parse(cls, params: dict) -> "PageRequest":
        """From query parameters, a repeated one being a list: it counts as absent, but for attributes."""
        found = common_filters(params)
        since, until = instant(params, "since"), instant(params, "until")
        if since is not None and until is not None and until < since:
            raise BadRequest("until must not be earlier than since")
        limit = DEFAULT_LIMIT
        if (raw := single(params, "limit")) is not None:
            if not re.fullmatch(r"[0-9]+", raw):
                raise BadRequest("limit must be a positive integer")
            if not 1 <= (limit := int(raw)) <= MAX_LIMIT:
                raise BadRequest(f"limit must be between 1 and {MAX_LIMIT}")
        cursor = single(params, "cursor")
        return cls(since=since, until=until, limit=limit, cursor=None if cursor is None else decode_cursor(cursor), **found)


def _row_filters(req: PageRequest) -> list:
    return entry_filters(req.service, req.level, req.attributes, req.q)


def _key_filters(req: PageRequest, partitioned: bool) -> list:
    return time_range(req.since, req.until, partitioned) + (before_cursor(*req.cursor) if req.cursor else [])


def page_keys(logs: DataFrame, req: PageRequest, extra: int = 1) -> DataFrame:
    """The page's rows, and one more that tells whether there is a next page; never more than limit + 1."""
    partitioned = "week_start" in logs.columns
    rows = logs.where(all_of(_key_filters(req, partitioned) + _row_filters(req)))
    return rows.orderBy(*newest_first()).limit(req.limit + extra)


def rendered(rows: DataFrame) -> DataFrame:
    """Ids as text, instants in milliseconds; after the limit, so that nothing is ordered by these forms."""
    return rows.select(F.col("id").cast("string").alias("id"), times.page_label(F.col("ts")).alias("timestamp"), "level", "service", "message", "attributes")


def page(logs: DataFrame, req: PageRequest) -> DataFrame:
    return rendered(page_keys(logs, req, 0))


def two_source_rows(logs: DataFrame, tokens: DataFrame, watermark: int, req: PageRequest, extra: int = 1) -> list[Row]:
    """The rows of a page by attributes, newest first: those below the watermark by their tokens, checked again on the row itself; others by the rows alone.

    The newest keys with all tokens are taken a few pages at a time. Rows are then read only
    between the first and last instant of these keys, given as literals, so that weeks and row
    groups outside are never opened; if hash collisions leave the page short, the next keys follow.
    """
    partitioned, n = "week_start" in logs.columns, req.limit + extra
    above = page_rows(logs.where(F.col("id") >= F.lit(watermark)), req, n)
    found: list[Row] = []
    before, take = req.cursor, 2 * n
    while len(found) < n:
        part = replace(req, cursor=before)
        keys = tokens.where(all_of([F.col("id") < F.lit(watermark), *_key_filters(part, False), *has_tokens(req.attributes)])).select("ts", "id").orderBy(*newest_first()).limit(take).collect()
        if not keys:
            break
        low, high = times.to_micros(keys[-1].ts), times.to_micros(keys[0].ts)
        # the ids are a filter and no join: it is pushed to the scan, and attributes are parsed only where it holds
        wanted = F.col("id").isin([k.id for k in keys])
        near = logs.where(all_of(time_range(low, high + 1, partitioned) + [F.col("id") < F.lit(watermark), wanted] + _row_filters(req)))
        at = {(k.ts, k.id) for k in keys}
        found += [r for r in near.select(*LOGS.fieldNames()).collect() if (r.ts, r.id) in at]
        if len(keys) < take:
            break
        before, take = (low, keys[-1].id), min(2 * take, 4 * (MAX_LIMIT + 1))
    return sorted(above + found, key=lambda r: (r.ts, r.id), reverse=True)[:n]


def page_rows(logs: DataFrame, req: PageRequest, n: int) -> list[Row]:
    return page_keys(logs, req, n - req.limit).select(*LOGS.fieldNames()).collect()


def two_source_page(logs: DataFrame, tokens: DataFrame, watermark: int, req: PageRequest, extra: int = 0) -> DataFrame:
    """The rows of two_source_rows, which are at most MAX_LIMIT + 1."""
    rows = two_source_rows(logs, tokens, watermark, req, extra)
    return logs.sparkSession.createDataFrame([tuple(r) for r in rows], LOGS).orderBy(*newest_first())


def fetch(rows: DataFrame, limit: int) -> tuple[list[dict], str | None]:
    """(rows as they are shown, cursor of the next page or None) from at most limit + 1 rows in order."""
    found = rows.select("id", "ts", "level", "service", "message", "attributes", times.page_label(F.col("ts")).alias("label")).collect()
    shown = [{"id": str(r.id), "timestamp": r.label, "level": r.level, "service": r.service, "message": r.message, "attributes": json.loads(r.attributes)} for r in found[:limit]]
    last = found[limit - 1] if len(found) > limit else None
    return shown, None if last is None else encode_cursor(times.to_micros(last.ts), last.id)


def query(logs: DataFrame, req: PageRequest, tokens: DataFrame | None = None, watermark: int = 0) -> tuple[list[dict], str | None]:
    """A page; by the token table if the request has attributes and the table is given."""
    if req.attributes and tokens is not None:
        return fetch(two_source_page(logs, tokens, watermark, req, 1), req.limit)
    return fetch(page_keys(logs, req), req.limit)
