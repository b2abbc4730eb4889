"""Retention: rows before the cutoff are in no answer, whole weeks go as directories, and the derived tables follow one and the same cutoff."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..sources import files
from ..sources.logs import LogTable
from .attrindex import TokenTable
from .rollup import RollupTable, folded


def cutoff(now: int, days: int) -> int:
    return now - days * 86400 * times.SECOND


def surviving(logs: DataFrame, at: int) -> DataFrame:
    return logs.where(F.col("ts") >= times.at(at))


def dropped_weeks(logs: DataFrame, at: int) -> DataFrame:
    """(week_start, n): the weeks that end at or before the cutoff."""
    weeks = logs.select(times.week_start(F.col("ts")).alias("week_start")).groupBy("week_start").agg(F.count("*").alias("n"))
    return weeks.where(F.date_add("week_start", 7).cast("timestamp_ntz") <= times.at(at))


def rollup_after(rollup: DataFrame, logs: DataFrame, watermark: int, at: int, width: int = 10) -> DataFrame:
    """The pre-aggregate after the cutoff: later buckets as they are, the cutoff's own bucket counted anew, from rows below the watermark alone."""
    edge = times.floor_to(at, width)
    kept = rollup.where(F.col("bucket_start") > times.at(edge)).select("bucket_start", "service", "level", "entry_count")
    own = logs.where((F.col("ts") >= times.at(at)) & (F.col("ts") < times.at(edge + width * times.SECOND)))
    return kept.unionByName(folded(own, 0, watermark, width))


def enforce(table: LogTable, at: int, rollup: RollupTable | None = None, tokens: TokenTable | None = None) -> dict:
    """Applies the cutoff everywhere; a later one that holds already stays.

    The cutoff is committed first, and from then on no answer from rows holds an older one. What
    follows only makes the derived tables agree and frees space, each step whole or not at all: a
    run that dies anywhere is run again, and nothing that is kept is ever moved or written anew.
    The week that the cutoff cuts stays stored until all of it is older.
    """
    at = table.cut(at)
    if rollup is not None:
        rollup.replace(lambda state: rollup_after(rollup.read(state), table.read(), state["watermark_id"], at, state["width"]))
    if tokens is not None:
        tokens.trim(times.at(at))
    gone, cut = [], None
    for week in table.weeks():
        start = date.fromisoformat(week)
        if times.to_micros(datetime.combine(start + timedelta(days=7), datetime.min.time())) <= at:
            files.delete(table.spark, f"{table.path}/week_start={week}")
            gone.append(week)
        elif times.to_micros(datetime.combine(start, datetime.min.time())) < at:
            cut = week
    return {"cutoff": at, "dropped": gone, "cut": cut}
