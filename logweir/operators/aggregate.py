"""Time-bucketed counts, from rows, from the pre-aggregate, or from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.predicates import all_of, any_of, entry_filters, time_range
from ..model import GROUPS
from ..plans.routing import AggregateRequest, Plan, actual_path, plan


def _group(name: str | None) -> Column:
    if name is not None and name not in GROUPS:
        raise ValueError(f"no group {name}")
    return F.lit(None).cast("string") if name is None else F.col(name)


def _raw_parts(logs: DataFrame, req: AggregateRequest, ranges) -> DataFrame:
    """(bucket, group, n, rollup_rows, raw_rows) of the rows in the ranges, which are disjoint."""
    partitioned = "week_start" in logs.columns
    each = [all_of(time_range(r.since, r.until, partitioned) + ([] if r.min_id is None else [F.col("id") >= F.lit(r.min_id)])) for r in ranges]
    whole = time_range(min(r.since for r in ranges), max(r.until for r in ranges), partitioned)  # a plain range reaches the scan
    rows = logs.where(all_of(whole + [any_of(each)] + entry_filters(req.service, req.level, req.attributes, req.q)))
    keyed = rows.select(times.time_bin(F.col("ts"), req.seconds).alias("bucket"), _group(req.group_by).alias("group"))
    counts = keyed.groupBy("bucket", "group").agg(F.count("*").alias("n"))
    return counts.select("bucket", "group", "n", F.lit(0).cast("long").alias("rollup_rows"), F.col("n").alias("raw_rows"))


def _rollup_parts(rollup: DataFrame, req: AggregateRequest, low: int, high: int) -> DataFrame:
    stored = rollup.where(all_of([F.col("bucket_start") >= times.at(low), F.col("bucket_start") < times.at(high), *entry_filters(req.service, req.level)]))
    keyed = stored.select(times.time_bin(F.col("bucket_start"), req.seconds).alias("bucket"), _group(req.group_by).alias("group"), "entry_count")
    counts = keyed.groupBy("bucket", "group").agg(F.sum("entry_count").cast("long").alias("n"), F.count("*").alias("rollup_rows"))
    return counts.select("bucket", "group", "n", "rollup_rows", F.lit(0).cast("long").alias("raw_rows"))


def counts(logs: DataFrame, req: AggregateRequest, rollup: DataFrame | None = None, watermark: int = 0, stored: int = 10) -> DataFrame:
    """(start, group, count, rollup_rows, raw_rows), one row for each bucket that has rows; group is null without grouping."""
    found: Plan = plan(req, watermark if rollup is not None else 0, stored)
    parts = _raw_parts(logs, req, found.raw)
    if found.rollup:
        both = _rollup_parts(rollup, req, *found.rollup).unionByName(parts)
        parts = both.groupBy("bucket", "group").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "rollup_rows", "raw_rows")])
    return parts.select(times.bucket_label(F.col("bucket")).alias("start"), "group", F.col("n").alias("count"), "rollup_rows", "raw_rows")


def buckets(logs: DataFrame, req: AggregateRequest, **source) -> DataFrame:
    """(start, group, count)."""
    return counts(logs, req, **source).select("start", "group", "count")


def answer(logs: DataFrame, req: AggregateRequest, **source) -> tuple[list[dict], str]:
    """The buckets in order of start and group, and the path that answered."""
    rows = counts(logs, req, **source).orderBy("start", F.coalesce("group", F.lit(""))).collect()
    path = actual_path(sum(r.rollup_rows for r in rows), sum(r.raw_rows for r in rows))
    return [{"start": r.start, "group": r.group, "count": r["count"]} for r in rows], path


def merged(*parts: DataFrame) -> DataFrame:
    """Sums partial (start, group, count) results."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("start", "group").agg(F.sum("count").cast("long").alias("count"))


def conservation(logs: DataFrame, rollup: DataFrame, watermark: int) -> DataFrame:
    """One row: the rows below the watermark, and the pre-aggregate's sum."""
    own = logs.where(F.col("id") < watermark).agg(F.count("*").alias("n_logs"))
    kept = rollup.agg(F.coalesce(F.sum("entry_count"), F.lit(0)).cast("long").alias("n_rollup"))
    return own.join(kept)
