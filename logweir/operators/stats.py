"""Analyses of logs, of latencies, and of what pages returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..functions.strings import attribute_map
from ..model import EDGES

RESERVOIR = 4096


def reservoir_percentiles(rows: DataFrame, key: str, value: str, order: list[Column], percents=(50, 95, 99), size: int = RESERVOIR) -> DataFrame:
    """p50, p95, p99 of the last samples of each key: the element at floor(p/100 * n) of the sorted ones.

    Only the last few of a key are ever gathered; the ranking is cut before the shuffle.
    """
    last = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= size)
    kept = last.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("xs"))
    at = lambda p: F.element_at("xs", (F.least(F.size("xs") - 1, F.floor(F.lit(p) * F.size("xs") / 100).cast("int")) + 1))
    return kept.select(key, F.size("xs").cast("long").alias("n"), *[at(p).alias(f"p{p}") for p in percents])


def _edge(value: Column, edges=EDGES) -> Column:
    out = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(value < e, i).otherwise(out)
    return out


def histogram(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slot, n): a value belongs to the first slot whose edge is above it, the last having none."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, _edge(F.col(value)).alias("slot")).agg(F.count("*").alias("n"))


def histogram_percentiles(rows: DataFrame, value: str, key: str, fractions=(0.5, 0.95)) -> DataFrame:
    """(key, p50, p95): the first edge at which the cumulated counts reach the fraction; beyond the last edge, that edge."""
    slots = histogram(rows, value, (key,))
    by_key = Window.partitionBy(key)  # eight rows at most
    run = slots.withColumns({"seen": F.sum("n").over(by_key.orderBy("slot")), "total": F.sum("n").over(by_key)})
    edges = F.array(*map(F.lit, (*EDGES, EDGES[-1])))
    first = lambda f: F.get(edges, F.min(F.when(F.col("seen") >= F.col("total") * f, F.col("slot")))).cast("int").alias(f"p{round(f * 100)}")
    return run.groupBy(key).agg(*map(first, fractions))


def throughput(logs: DataFrame, seconds: int = 5) -> DataFrame:
    """(start, n) by tumbling window."""
    return logs.select(times.time_bin(F.col("ts"), seconds).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).select(times.bucket_label(F.col("bin")).alias("start"), "n")


def collapse(logs: DataFrame, seconds: int) -> DataFrame:
    """One row: peak of the windows, mean of those in the second half of the time span, and mean over peak."""
    windows = logs.select(times.time_bin(F.col("ts"), seconds).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    span = windows.agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.max("n").alias("peak"))
    second = windows.join(F.broadcast(span)).where((F.col("bin") - F.col("low")) * 2 >= F.col("high") - F.col("low"))  # one row
    return second.groupBy("peak").agg(F.avg("n").alias("second_half")).select("peak", "second_half", (F.col("second_half") / F.col("peak")).alias("ratio"))


def interval_union(rows: DataFrame, key: str, begin: str, end: str, slice_seconds: int = 3600) -> DataFrame:
    """(key, covered_us): the length of the union of a key's intervals [begin, end), in microseconds.

    Intervals are cut at fixed slices of time, in each of which the union is measured alone, so
    that a busy key is dealt over its slices.
    """
    width = slice_seconds * times.SECOND
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cut = rows.select(key, us(begin).alias("b"), us(end).alias("e")).where("e > b")
    cut = cut.select(key, "b", "e", F.explode(F.sequence(F.floor(F.col("b") / width), F.floor((F.col("e") - 1) / width))).alias("slice"))
    cut = cut.select(key, "slice", F.greatest("b", F.col("slice") * width).alias("b"), F.least("e", (F.col("slice") + 1) * width).alias("e"))
    before = F.max("e").over(Window.partitionBy(key, "slice").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("e") - F.greatest("b", F.coalesce(before, F.col("b"))), F.lit(0))
    return cut.select(key, new.alias("new")).groupBy(key).agg(F.sum("new").cast("long").alias("covered_us"))


def attribute_frequency(logs: DataFrame) -> DataFrame:
    """(k, v, n) over all attributes."""
    return logs.select(F.explode(attribute_map(F.col("attributes"))).alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))


def frequency_top(logs: DataFrame, n: int = 1, rarest: bool = False) -> DataFrame:
    """The n most frequent attributes, or the rarest; ties go by key and value."""
    return attribute_frequency(logs).orderBy(F.col("n") if rarest else F.desc("n"), "k", "v").limit(n)


def numbered(logs: DataFrame, seconds: int = 86400) -> DataFrame:
    """(ts, id, rn): the place of each row in the newest-first order, without sorting all rows in one task.

    Rows are numbered within slices of time; the slices' totals, a few rows each, are summed up.
    """
    rows = logs.select(times.time_bin(F.col("ts"), seconds).alias("slice"), "ts", "id")
    totals = rows.groupBy("slice").agg(F.count("*").alias("n"))
    before = totals.select("slice", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("ts"), F.desc("id")))
    return rows.withColumn("within", within).join(before, "slice").select("ts", "id", (F.col("before") + F.col("within")).cast("long").alias("rn"))


def boundary_cursors(logs: DataFrame, limit: int, pages: int) -> DataFrame:
    """(page, ts, id): the last row of each of the first pages. Only the rows of these pages are numbered: a top-k, cut before it is shuffled."""
    first = logs.select("ts", "id").orderBy(F.desc("ts"), F.desc("id")).limit(limit * pages)
    return numbered(first).where((F.col("rn") % limit == 0) & (F.col("rn") <= limit * pages)).select((F.col("rn") / limit).cast("long").alias("page"), "ts", "id")


def order_violations(walk: DataFrame) -> DataFrame:
    """One row: steps of a walk (pos, ts, id) at which (ts, id) doesn't fall. Neighbours meet by an equi-join on the position."""
    after = walk.select((F.col("pos") - 1).alias("pos"), F.struct("ts", "id").alias("next"))
    return walk.select("pos", F.struct("ts", "id").alias("here")).join(after, "pos").agg(F.count_if(F.col("next") >= F.col("here")).alias("violations"))


def duplicates(walk: DataFrame) -> DataFrame:
    """(id, n) of ids that a walk returned more than once."""
    return walk.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def contiguity(rows: DataFrame) -> DataFrame:
    """One row: least and largest id, their number, and whether none is missing."""
    return rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).withColumn("contiguous", F.col("hi") - F.col("lo") + 1 == F.col("n"))


def depth_drift(pages: DataFrame, total: int) -> DataFrame:
    """One row: mean time of the last tenth of pages (page, ms; pages numbered from 1) over that of the first."""
    tenth = max(1, total // 10)
    return pages.agg(F.avg(F.when(F.col("page") > total - tenth, F.col("ms"))).alias("last"), F.avg(F.when(F.col("page") <= tenth, F.col("ms"))).alias("first")).withColumn("drift", F.col("last") / F.col("first"))


def request_keys(requests: DataFrame, key: str) -> DataFrame:
    """One row: requests, distinct keys, and repeats."""
    per = requests.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_requests"), F.count("*").alias("n_distinct")).withColumn("n_repeats", F.col("n_requests") - F.col("n_distinct"))


def concurrent_repeats(requests: DataFrame, key: str, begin: str, end: str, slice_seconds: int = 3600) -> DataFrame:
    """One row: requests that begin while an earlier one with the same key still runs; of those that begin at once, all but the one that ends first.

    Requests are dealt to slices of time by their begin, and a window runs in each slice alone; how
    far earlier slices of the key reach comes from their latest ends, one row a slice, so that a
    busy key is dealt over its slices.
    """
    bin_ = times.time_bin(F.col(begin), slice_seconds)
    rows = requests.select(F.col(key).alias("key"), F.col(begin).alias("begin"), F.col(end).alias("end"), bin_.alias("slice")).where("begin is not null")
    within = F.max("end").over(Window.partitionBy("key", "slice").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    reach = rows.groupBy("key", "slice").agg(F.max("end").alias("latest"))
    reach = reach.select("key", "slice", F.max("latest").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("reach"))
    both = rows.withColumn("within", within).join(reach, (rows["key"].eqNullSafe(reach["key"])) & (rows["slice"] == reach["slice"]))
    return both.agg(F.count_if(F.coalesce(F.greatest("within", "reach") > F.col("begin"), F.lit(False))).alias("n_concurrent"))


def backlog(logs: DataFrame, watermark: int) -> DataFrame:
    return logs.agg(F.greatest(F.lit(0), F.coalesce(F.max("id") + 1 - watermark, F.lit(0))).cast("long").alias("backlog"))


def hot_tail(logs: DataFrame, safe_before: int, row_bytes: float) -> DataFrame:
    """One row: rows at or after an instant, and their share of bytes."""
    return logs.agg(F.count_if(F.col("ts") >= times.at(safe_before)).alias("n")).withColumn("bytes", F.round(F.col("n") * F.lit(row_bytes)).cast("long"))


def medians(samples: DataFrame, tail: str, duration: str, interval_ms: float) -> DataFrame:
    """One row: medians of the tail and the refresh time, and the share of the interval that refreshes take, in percent."""
    return samples.agg(F.percentile(tail, 0.5).alias("tail_median"), F.percentile(duration, 0.5).alias("duration_median")).withColumn("duty", F.col("duration_median") / F.lit(interval_ms) * 100)


def amplification(rows_written: int, writes: int, transactions: int) -> dict:
    """Writes and transactions for each 1,000 logs, rows for each write."""
    return {"writes_per_1000": 1000 * writes / rows_written if rows_written else 0.0, "transactions_per_1000": 1000 * transactions / rows_written if rows_written else 0.0, "rows_per_write": rows_written / writes if writes else 0.0}


def bounded_count(logs: DataFrame, n: int) -> DataFrame:
    return logs.orderBy(F.desc("ts"), F.desc("id")).limit(n).agg(F.count("*").alias("n"))
