"""Filters of pages and counts: conjunctions of the same few predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times
from .strings import attribute_map, contains_folded, token


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts) if parts else F.lit(False)


def time_range(since: int | None, until: int | None, partitioned: bool = False) -> list[Column]:
    """since inclusive, until exclusive. On a table partitioned by week the weeks are bounded as well, which its layout can't derive."""
    out = []
    if since is not None:
        out.append(F.col("ts") >= times.at(since))
        if partitioned:
            out.append(F.col("week_start") >= times.week_start(times.at(since)))
    if until is not None:
        out.append(F.col("ts") < times.at(until))
        if partitioned:
            out.append(F.col("week_start") <= times.week_start(times.at(until)))
    return out


def entry_filters(service: str | None = None, level: str | None = None, attributes: dict[str, str] | None = None, q: str | None = None) -> list[Column]:
    out = []
    if service is not None:
        out.append(F.col("service") == F.lit(service))
    if level is not None:
        out.append(F.col("level") == F.lit(level))
    for key, value in (attributes or {}).items():
        out.append(F.coalesce(attribute_map(F.col("attributes"))[F.lit(key)] == F.lit(value), F.lit(False)))
    if q is not None:
        out.append(contains_folded(F.col("message"), q))
    return out


def before_cursor(us: int, id_: int) -> list[Column]:
    """(ts, id) < (us, id_), and the bound on ts that it entails, which prunes."""
    at = times.at(us)
    return [F.col("ts") <= at, (F.col("ts") < at) | ((F.col("ts") == at) & (F.col("id") < F.lit(id_)))]


def has_tokens(attributes: dict[str, str]) -> list[Column]:
    return [F.array_contains("tokens", token(F.lit(k), F.lit(v))) for k, v in attributes.items()]
