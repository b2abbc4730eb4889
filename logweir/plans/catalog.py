"""Named queries over the fixture tables, and their SQL for DuckDB. The events table stands for logs."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.strings import contains_folded, copy_escaped, sanitized
from ..model import BUCKETS, Settings
from ..operators import attrindex, page, retention, rollup, stats, validate
from ..operators.aggregate import answer, buckets, conservation, merged
from ..sources import files
from ..sources.logs import LogTable, entries, from_events, seeded
from ..streaming.ingest import Engine
from .routing import AggregateRequest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOGS = """logs AS (SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' ELSE 'debug' END AS level,
  'svc-' || (user_id % 8) AS service, event_type || ' by user ' || user_id AS message, props AS attributes FROM events)"""
#: The same logs with several attributes of different types, and with wildcard characters in some messages.
RICH = LOGS.replace("logs AS", "rich AS").replace("event_type || ' by user ' || user_id AS message", "CASE WHEN user_id % 5 = 0 THEN '100%_of ' ELSE '' END || event_type || ' by user ' || user_id AS message, event_type, user_id, event_id, json_extract_string(props, '$.k') AS k")
SINCE, UNTIL = "2024-01-01", "2024-02-01"
UNALIGNED = ("2024-01-05T10:17:23.000451Z", "2024-01-21T03:44:59.999950Z")


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rich_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    attributes = F.to_json(F.struct(k, F.col("event_type").alias("type"), (F.col("user_id") / 4).alias("ratio"), (F.col("event_id") % 2 == 0).alias("even")))
    marked = F.concat(F.when(F.col("user_id") % 5 == 0, "100%_of ").otherwise(""), "message")
    return from_events(events.withColumn("props", attributes)).join(events.select(F.col("event_id").alias("id"), "user_id"), "id").withColumn("message", marked).drop("user_id")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            needs = [text for table, text in (("logs", LOGS), ("rich", RICH)) if re.search(rf"\b{table}\b", sql)]
            ORACLE_SQL[name] = f"WITH {', '.join(needs)} {sql}" if needs and not sql.lstrip().startswith("WITH") else sql
        return f

    return add


def request(bucket="1h", since=SINCE, until=UNTIL, **more) -> AggregateRequest:
    return AggregateRequest(since=times.parse_iso(since), until=times.parse_iso(until), bucket=bucket, **more)


def count_sql(bucket: str, group: str | None, where: str = "TRUE", since: str = SINCE, until: str = UNTIL) -> str:
    stamp = lambda x: f"TIMESTAMP '{times.from_micros(times.parse_iso(x))}'"
    return f"""SELECT strftime(time_bucket(INTERVAL {BUCKETS[bucket]} SECONDS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, {group or 'NULL::VARCHAR'} AS "group", count(*) AS count
FROM logs WHERE ts >= {stamp(since)} AND ts < {stamp(until)} AND {where} GROUP BY 1, 2"""


def _counting(name: str, req: AggregateRequest, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: buckets(logs_of(spark, sf_dir), req))


for _b in BUCKETS:
    for _g in (None, "service", "level"):
        _counting(f"agg_{_b}_{_g or 'none'}", request(_b, group_by=_g), count_sql(_b, _g))
for _name, _req, _sql in (
    ("service", request(service="svc-3"), count_sql("1h", None, "service = 'svc-3'")),
    ("level", request(level="error", group_by="service"), count_sql("1h", "service", "level = 'error'")),
    ("service_level", request("1d", service="svc-1", level="warn"), count_sql("1d", None, "service = 'svc-1' AND level = 'warn'")),
    ("q", request("1d", q="BY USER 12", group_by="level"), count_sql("1d", "level", "contains(lower(message), 'by user 12')")),
    ("attr", request("1d", attributes={"k": "7"}), count_sql("1d", None, "json_extract_string(attributes, '$.k') = '7'")),
    ("unaligned", request("5m", *UNALIGNED), count_sql("5m", None, since=UNALIGNED[0], until=UNALIGNED[1])),
):
    _counting(f"agg_filter_{_name}", _req, _sql)


for _name, _attrs, _where in (
    ("multi_attr", {"k": "7", "type": "click"}, "k = '7' AND event_type = 'click'"),
    ("typed_attr", {"even": "true", "ratio": "2.5"}, "event_id % 2 = 0 AND user_id = 10"),
    ("absent_attr", {"k": "7", "absent": "x"}, "FALSE"),
):
    query(f"agg_filter_{_name}", f"SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS rows, count(*) AS buckets FROM ({count_sql('1d', None, _where).replace('FROM logs', 'FROM rich')})")(
        lambda spark, sf_dir, a=_attrs: buckets(rich_of(spark, sf_dir), request("1d", attributes=a)).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("buckets"))
    )


@query("agg_filter_empty", f"SELECT count(*) AS buckets FROM ({count_sql('1h', None, until=SINCE)})")
def _empty(spark, sf_dir):
    return buckets(logs_of(spark, sf_dir), request(until=SINCE)).agg(F.count("*").alias("buckets"))


@query("rollup_fold_10s", "SELECT time_bucket(INTERVAL 10 SECONDS, ts, TIMESTAMP '1970-01-01') AS bucket_start, service, level, count(*) AS entry_count FROM logs GROUP BY ALL")
def _fold(spark, sf_dir):
    return rollup.folded(logs_of(spark, sf_dir), 0, 2**62)


def stored_rollup(spark: SparkSession, logs: DataFrame, below: int, folds: int = 3, **settings) -> rollup.RollupTable:
    """A pre-aggregate of its own, folded in a few steps up to an id."""
    table = rollup.RollupTable(spark, scratch(spark, "rollup"), Settings(max_fold_rows=max(1, -(-below // folds)), **settings))
    while table.fold(logs, below=below) != rollup.NOTHING:
        pass
    return table


def scratch(spark: SparkSession, name: str) -> str:
    return f"{files.shared_dir(spark)}/logweir/{name}-{uuid.uuid4().hex}"


@query("rollup_incremental_fold", "SELECT time_bucket(INTERVAL 10 SECONDS, ts, TIMESTAMP '1970-01-01') AS bucket_start, service, level, count(*) AS entry_count FROM logs GROUP BY ALL")
def _fold_twice(spark, sf_dir):
    table = stored_rollup(spark, logs_of(spark, sf_dir), 2 * _half(spark, sf_dir), folds=5)
    table.compact()
    return table.read()


def _hybrid(logs: DataFrame, req: AggregateRequest, watermark: int) -> DataFrame:
    return buckets(logs, req, **stored_rollup(logs.sparkSession, logs, watermark).source())


def _half(spark, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count() // 2


for _b in BUCKETS:
    query(f"agg_hybrid_mid_watermark_{_b}", count_sql(_b, "service", since=UNALIGNED[0], until=UNALIGNED[1]))(
        lambda spark, sf_dir, b=_b: _hybrid(logs_of(spark, sf_dir), request(b, *UNALIGNED, group_by="service"), _half(spark, sf_dir))
    )


@query("agg_hybrid_late_ids", count_sql("1h", "level"))
def _late(spark, sf_dir):
    n = 2 * _half(spark, sf_dir)
    logs = logs_of(spark, sf_dir).withColumn("id", F.pmod(F.col("id") * 7919, F.lit(n)))  # ids no longer follow time
    return _hybrid(logs, request(group_by="level"), n // 2)


@query("agg_rollup_only", count_sql("1d", "service"))
def _rollup_only(spark, sf_dir):
    return _hybrid(logs_of(spark, sf_dir), request("1d", group_by="service"), 2 * _half(spark, sf_dir))


@query("agg_merged_halves", count_sql("1h", "service"))
def _merged(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    return merged(buckets(logs, request(until="2024-01-15T12:30:00Z", group_by="service")), buckets(logs, request(since="2024-01-15T12:30:00Z", group_by="service")))


@query(
    "agg_path_rows",
    f"""SELECT * FROM (SELECT 'search' AS request, 'raw' AS path, count(*) AS rows FROM logs WHERE contains(lower(message), 'error') UNION ALL SELECT 'aligned', 'rollup', count(*) FROM logs
UNION ALL SELECT 'unaligned', 'hybrid', count(*) FROM logs WHERE ts >= TIMESTAMP '{times.from_micros(times.parse_iso(UNALIGNED[0]))}' AND ts < TIMESTAMP '{times.from_micros(times.parse_iso(UNALIGNED[1]))}' UNION ALL SELECT 'empty', 'raw', 0)""",
)
def _path(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    whole, half = (stored_rollup(spark, logs, n).source() for n in (2 * _half(spark, sf_dir), _half(spark, sf_dir)))
    found = []
    for name, req, source in (("search", request("1d", q="error"), whole), ("aligned", request("1d"), whole), ("unaligned", request("1m", *UNALIGNED), half), ("empty", request(until=SINCE), whole)):
        rows, path = answer(logs, req, **source)
        found.append((name, path, sum(r["count"] for r in rows)))
    return spark.createDataFrame(found, "request string, path string, rows long")


@query("conservation_check", "SELECT count(*) AS n_logs, count(*) AS n_rollup FROM logs WHERE id < (SELECT max(id) FROM logs) - 10")
def _conservation(spark, sf_dir):
    logs = LogTable(spark, scratch(spark, "logs"))
    logs.append(logs_of(spark, sf_dir))
    below = 2 * _half(spark, sf_dir) - 11  # the last writes aren't settled
    return conservation(logs.read(), stored_rollup(spark, logs.read(), below).read(), below)


@query("rollup_bounds", "SELECT min(b) AS oldest, max(b) AS newest FROM (SELECT time_bucket(INTERVAL 10 SECONDS, ts, TIMESTAMP '1970-01-01') AS b FROM logs)")
def _bounds(spark, sf_dir):
    return rollup.bounds(rollup.folded(logs_of(spark, sf_dir), 0, 2**62))


PAGE = "SELECT CAST(id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service, message, attributes FROM logs"


def _paged(name: str, req: page.PageRequest, where: str) -> None:
    query(name, f"{PAGE} WHERE {where} ORDER BY ts DESC, logs.id DESC LIMIT {req.limit}")(lambda spark, sf_dir: page.page(logs_of(spark, sf_dir), req))


_paged("page_first", page.PageRequest(), "TRUE")
_paged("page_filtered", page.PageRequest(service="svc-2", level="debug", since=times.parse_iso("2024-01-10"), until=times.parse_iso("2024-01-20")), "service = 'svc-2' AND level = 'debug' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
_paged("page_q", page.PageRequest(q="Purchase BY", limit=50), "contains(lower(message), 'purchase by')")
_paged("page_attr", page.PageRequest(attributes={"k": "42"}, limit=1000), "json_extract_string(attributes, '$.k') = '42'")


for _name, _q in (("page_q_wildcard", "%"), ("page_q_wildcards", "100%_OF P")):
    query(_name, f"{PAGE.replace('attributes', 'k').replace('FROM logs', 'FROM rich')} WHERE contains(lower(message), '{_q.lower()}') ORDER BY ts DESC, rich.id DESC LIMIT 100")(
        lambda spark, sf_dir, q=_q: page.page(rich_of(spark, sf_dir), page.PageRequest(q=q)).withColumn("k", F.get_json_object("attributes", "$.k")).drop("attributes")
    )


@query("page_limit_plus_one", f"{PAGE} ORDER BY ts DESC, logs.id DESC LIMIT 101")
def _look_ahead(spark, sf_dir):
    return page.rendered(page.page_keys(logs_of(spark, sf_dir), page.PageRequest()))


@query("page_second", f"{PAGE} ORDER BY ts DESC, logs.id DESC LIMIT 100 OFFSET 100")
def _second(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    cursor = page.query(logs, page.PageRequest())[1]
    return page.page(logs, page.PageRequest(cursor=page.decode_cursor(cursor)))


@query("page_attr_two_source", f"{PAGE} WHERE json_extract_string(attributes, '$.k') = '42' AND level <> 'x' ORDER BY ts DESC, logs.id DESC LIMIT 100")
def _two_source(spark, sf_dir):
    logs, half = logs_of(spark, sf_dir), _half(spark, sf_dir)
    return page.rendered(page.two_source_page(logs, stored_tokens(spark, logs, half).read(), half, page.PageRequest(attributes={"k": "42"})))


def stored_tokens(spark: SparkSession, logs: DataFrame, below: int) -> attrindex.TokenTable:
    """A token table of its own, indexed up to an id."""
    table = attrindex.TokenTable(spark, scratch(spark, "tokens"), Settings(index_min_rows=max(1, -(-below // 2)), index_max_rows=max(200, below)))
    while table.index(logs, below):
        pass
    return table


@query("q_unicode_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ñ') OR contains(lower(text), 'é')")
def _unicode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(contains_folded(F.col("text"), "Ñ") | contains_folded(F.col("text"), "É")).select("doc_id")


@query("q_literal_wildcard", "SELECT doc_id, contains(lower(text), '%%%') AS percents, contains(lower(text), '_') AS underscores FROM documents WHERE contains(lower(text), '%%%') OR contains(lower(text), '_')")
def _wildcard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    percents, underscores = contains_folded(F.col("text"), "%%%"), contains_folded(F.col("text"), "_")
    return docs.where(percents | underscores).select("doc_id", percents.alias("percents"), underscores.alias("underscores"))


for _name, _rare in (("top", False), ("bottom", True)):
    query(f"attr_frequency_{_name}", f"SELECT 'k' AS k, json_extract_string(attributes, '$.k') AS v, count(*) AS n FROM logs GROUP BY ALL ORDER BY n {'ASC' if _rare else 'DESC'}, k, v LIMIT 1")(
        lambda spark, sf_dir, r=_rare: stats.frequency_top(logs_of(spark, sf_dir), 1, r)
    )


@query("attr_token_selfconsistency", "SELECT count(*) AS n_hits, count(*) AS n_rows FROM logs WHERE json_extract_string(attributes, '$.k') = '42'")
def _tokens(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    hits = stored_tokens(spark, logs, 2 * _half(spark, sf_dir)).read().where(page.has_tokens({"k": "42"})[0])
    return hits.agg(F.count("*").alias("n_hits")).join(logs.where(page.all_of(page.entry_filters(attributes={"k": "42"}))).agg(F.count("*").alias("n_rows")))


@query("attr_index_rows", "SELECT count(*) AS n, sum(CASE WHEN attributes IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_tokens FROM logs")
def _index_rows(spark, sf_dir):
    return attrindex.indexed(logs_of(spark, sf_dir), 0, 2**62).agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("n_tokens"))


@query("page_boundary_cursors", "SELECT rn // 100 AS page, ts, id FROM (SELECT ts, id, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn FROM logs) WHERE rn % 100 = 0 AND rn <= 700")
def _cursors(spark, sf_dir):
    return stats.boundary_cursors(logs_of(spark, sf_dir), 100, 7)


@query("keyset_walk_violations", "SELECT count(*) FILTER (WHERE (ts, id) >= (pts, pid)) AS violations FROM (SELECT ts, id, lag(ts) OVER w AS pts, lag(id) OVER w AS pid FROM logs WINDOW w AS (ORDER BY ts DESC, id DESC))")
def _walk(spark, sf_dir):
    return stats.order_violations(stats.numbered(logs_of(spark, sf_dir)).withColumnRenamed("rn", "pos"))


@query("duplicate_ids", "SELECT id, count(*) AS n FROM (SELECT id FROM logs UNION ALL SELECT id FROM logs WHERE id % 100 = 0) GROUP BY id HAVING count(*) > 1")
def _duplicates(spark, sf_dir):
    ids = logs_of(spark, sf_dir).select("id")
    return stats.duplicates(ids.unionByName(ids.where("id % 100 = 0")))


@query("id_contiguity", "SELECT min(id) AS lo, max(id) AS hi, count(*) AS n, max(id) - min(id) + 1 = count(*) AS contiguous FROM logs")
def _contiguity(spark, sf_dir):
    return stats.contiguity(logs_of(spark, sf_dir))


@query("page_depth_drift", "WITH p AS (SELECT event_id + 1 AS page, value AS ms, count(*) OVER () AS n FROM events), a AS (SELECT avg(ms) FILTER (WHERE page > n - n // 10) AS last, avg(ms) FILTER (WHERE page <= n // 10) AS first FROM p) SELECT last, first, last / first AS drift FROM a")
def _drift(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("page"), F.col("value").alias("ms"))
    return stats.depth_drift(pages, pages.count())


def _services(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"), "ts", F.col("event_id").alias("id"), "value", "user_id", "event_type")


@query(
    "latency_percentiles_by_service",
    """WITH r AS (SELECT 'svc-' || (user_id % 8) AS service, value, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts DESC, event_id DESC) AS rn FROM events),
k AS (SELECT service, list_sort(list(value)) AS xs FROM r WHERE rn <= 4096 GROUP BY service)
SELECT service, CAST(len(xs) AS BIGINT) AS n, xs[least(len(xs) - 1, 50 * len(xs) // 100) + 1] AS p50, xs[least(len(xs) - 1, 95 * len(xs) // 100) + 1] AS p95, xs[least(len(xs) - 1, 99 * len(xs) // 100) + 1] AS p99 FROM k""",
)
def _percentiles(spark, sf_dir):
    return stats.reservoir_percentiles(_services(spark, sf_dir), "service", "value", [F.desc("ts"), F.desc("id")])


@query(
    "histogram_percentile",
    """WITH h AS (SELECT 'svc-' || (user_id % 8) AS service, CASE WHEN value < 5 THEN 0 WHEN value < 10 THEN 1 WHEN value < 20 THEN 2 WHEN value < 40 THEN 3 WHEN value < 80 THEN 4 WHEN value < 160 THEN 5 WHEN value < 320 THEN 6 ELSE 7 END AS slot, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT service, slot, sum(n) OVER (PARTITION BY service ORDER BY slot) AS seen, sum(n) OVER (PARTITION BY service) AS total FROM h)
SELECT service, [5, 10, 20, 40, 80, 160, 320, 320][min(slot) FILTER (WHERE seen >= total * 0.5) + 1] AS p50, [5, 10, 20, 40, 80, 160, 320, 320][min(slot) FILTER (WHERE seen >= total * 0.95) + 1] AS p95 FROM c GROUP BY service""",
)
def _histogram(spark, sf_dir):
    return stats.histogram_percentiles(_services(spark, sf_dir), "value", "service")


@query("throughput_tumbling", "SELECT strftime(time_bucket(INTERVAL 300 SECONDS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, count(*) AS n FROM logs GROUP BY 1")
def _throughput(spark, sf_dir):
    return stats.throughput(logs_of(spark, sf_dir), 300)


@query("throughput_collapse_ratio", "WITH w AS (SELECT time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01') AS bin, count(*) AS n FROM events GROUP BY 1), s AS (SELECT min(bin) AS low, max(bin) AS high, max(n) AS peak FROM w) SELECT peak, avg(n) AS second_half, avg(n) / peak AS ratio FROM w, s WHERE (bin - low) * 2 >= high - low GROUP BY peak")
def _collapse(spark, sf_dir):
    return stats.collapse(logs_of(spark, sf_dir), 3600)


@query(
    "interval_union_per_user",
    """WITH i AS (SELECT user_id, epoch_us(ts) AS b, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events),
m AS (SELECT user_id, b, e, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i WHERE e > b)
SELECT user_id, CAST(sum(greatest(e - greatest(b, coalesce(p, b)), 0)) AS BIGINT) AS covered_us FROM m GROUP BY user_id""",
)
def _union(spark, sf_dir):
    rows = _services(spark, sf_dir).select("user_id", F.col("ts").alias("b"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("value") * 60).cast("decimal(18,6)"))).alias("e"))
    return stats.interval_union(rows, "user_id", "b", "e")


@query("duplicate_request_keys", "WITH k AS (SELECT user_id || event_type || date_trunc('day', ts)::DATE AS k FROM events) SELECT count(*) AS n_requests, count(DISTINCT k) AS n_distinct, count(*) - count(DISTINCT k) AS n_repeats FROM k")
def _requests(spark, sf_dir):
    keys = _services(spark, sf_dir).select(F.concat(F.col("user_id").cast("string"), "event_type", F.col("ts").cast("date").cast("string")).alias("k"))
    return stats.request_keys(keys, "k")


@query(
    "concurrent_request_keys",
    """WITH r AS (SELECT user_id, ts AS b, ts + INTERVAL 6 HOURS AS e FROM events), m AS (SELECT b, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r)
SELECT count(*) FILTER (WHERE p > b) AS n_concurrent FROM m""",
)
def _concurrent(spark, sf_dir):
    rows = _services(spark, sf_dir).select("user_id", F.col("ts").alias("b"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("e"))
    return stats.concurrent_repeats(rows, "user_id", "b", "e")


@query("unindexed_backlog", "SELECT greatest(0, max(id) + 1 - 500) AS backlog FROM logs")
def _backlog(spark, sf_dir):
    return stats.backlog(logs_of(spark, sf_dir), 500)


@query("hot_tail_size", "SELECT count(*) AS n, CAST(round(count(*) * 240.0) AS BIGINT) AS bytes FROM logs WHERE ts >= TIMESTAMP '2024-01-29'")
def _tail(spark, sf_dir):
    return stats.hot_tail(logs_of(spark, sf_dir), times.parse_iso("2024-01-29"), 240.0)


@query("sample_medians", "SELECT quantile_cont(value, 0.5) AS tail_median, quantile_cont(user_id, 0.5)::DOUBLE AS duration_median, quantile_cont(user_id, 0.5) / 2000.0 * 100 AS duty FROM events")
def _medians(spark, sf_dir):
    return stats.medians(_services(spark, sf_dir), "value", "user_id", 2000.0)


@query("bounded_read_back", "SELECT count(*) AS n FROM (SELECT 1 FROM logs ORDER BY ts DESC, id DESC LIMIT 750)")
def _read_back(spark, sf_dir):
    return stats.bounded_count(logs_of(spark, sf_dir), 750)


CUTOFF = "2024-01-17T09:30:07.5Z"
CUTOFF_SQL = "TIMESTAMP '2024-01-17 09:30:07.5'"


@query("retention_surviving_rows", f"SELECT id FROM logs WHERE ts >= {CUTOFF_SQL}")
def _surviving(spark, sf_dir):
    return retention.surviving(logs_of(spark, sf_dir), times.parse_iso(CUTOFF)).select("id")


@query("retention_partitions_dropped", f"SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_start, count(*) AS n FROM logs GROUP BY 1 HAVING CAST(date_trunc('week', min(ts)) AS TIMESTAMP) + INTERVAL 7 DAYS <= {CUTOFF_SQL}")
def _dropped(spark, sf_dir):
    return retention.dropped_weeks(logs_of(spark, sf_dir), times.parse_iso(CUTOFF)).withColumn("week_start", F.col("week_start").cast("string"))


@query("rollup_retention_edge", f"SELECT time_bucket(INTERVAL 10 SECONDS, ts, TIMESTAMP '1970-01-01') AS bucket_start, service, level, count(*) AS entry_count FROM logs WHERE ts >= {CUTOFF_SQL} AND id < (SELECT count(*) // 2 * 2 FROM logs) - 100 GROUP BY ALL")
def _edge(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    w = 2 * _half(spark, sf_dir) - 100
    return retention.rollup_after(rollup.folded(logs, 0, w), logs, w, times.parse_iso(CUTOFF))


NOW = "2024-06-01T12:00:00Z"
# Entries and what is wrong with them.
BATCH = (
    ({"timestamp": "2024-06-01T11:59:00.123456Z", "level": "info", "service": "api", "message": "ok", "attributes": {"s": "x", "n": 3, "b": True, "f": 1.5, "neg": -2}}, None),
    ({"timestamp": "2024-06-01T11:59:00Z", "level": "fatal", "service": "api", "message": "m"}, validate.BAD_LEVEL),
    ({"timestamp": "2024-06-01T11:59:00Z", "level": "info", "service": "", "message": "m"}, validate.NO_SERVICE),
    ({"timestamp": "2024-06-01T11:59:00Z", "level": "info", "service": "api", "message": "  "}, validate.NO_MESSAGE),
    ({"timestamp": "yesterday", "level": "info", "service": "api", "message": "m"}, validate.BAD_TIME),
    ({"timestamp": "2024-06-01T12:10:00Z", "level": "info", "service": "api", "message": "m"}, validate.FUTURE),
    ({"timestamp": "2024-06-01T11:59:00Z", "level": "info", "service": "api", "message": "m", "attributes": {"a": {"b": 1}}}, validate.BAD_VALUES),
    ({"timestamp": "2024-06-01T11:59:00Z", "level": "info", "service": "api", "message": "m", "attributes": ["x"]}, validate.BAD_ATTRIBUTES),
    ({"level": "info", "service": "api", "message": "m"}, validate.NO_TIME),
    ("not an object", validate.NOT_OBJECT),
    ({"timestamp": "2024-06-01T12:05:00Z", "level": "warn", "service": "api", "message": "at the limit", "attributes": None}, None),
    ({"timestamp": "2024-06-01", "level": "error", "service": "\0", "message": "m"}, validate.NO_SERVICE),
    ({"timestamp": "2024-06-01T13:00:00+02:00", "level": "error", "service": "s" * 256, "message": "m"}, validate.LONG_SERVICE),
)


def _batch(spark) -> DataFrame:
    return validate.checked(entries(spark, [json.dumps(e) for e, _ in BATCH]), times.parse_iso(NOW))


@query("validate_batch_rejects", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, (_, r) in enumerate(BATCH) if r) + ') AS t("index", reason)')
def _rejects(spark, sf_dir):
    return validate.rejected(_batch(spark))


@query("validate_batch_accepted", """SELECT * FROM (VALUES (0, TIMESTAMP '2024-06-01 11:59:00.123456', 'info', 'api', 'ok', 5), (10, TIMESTAMP '2024-06-01 12:05:00', 'warn', 'api', 'at the limit', 0)) AS t("index", ts, level, service, message, n_attributes)""")
def _accepted(spark, sf_dir):
    rows = validate.accepted(_batch(spark))
    return rows.select("index", "ts", "level", "service", "message", F.json_object_keys("attributes").alias("k")).select("index", "ts", "level", "service", "message", F.size("k").alias("n_attributes"))


@query("sanitize_text", "SELECT doc_id, md5(replace(text || chr(0) || 'x', chr(0), '')) AS clean FROM documents")
def _sanitize(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(sanitized(F.concat("text", F.lit("\0x")))).alias("clean"))


@query("copy_escape", r"SELECT doc_id, md5(replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS escaped FROM documents")
def _escape(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(copy_escaped(F.col("text"))).alias("escaped"))


@query("week_partition_counts", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_start, count(*) AS n FROM logs GROUP BY 1")
def _weeks(spark, sf_dir):
    return logs_of(spark, sf_dir).groupBy(times.week_start(F.col("ts")).cast("string").alias("week_start")).agg(F.count("*").alias("n"))


@query("service_clustered_counts", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_start, count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM logs GROUP BY 1")
def _clustered(spark, sf_dir):
    """Rows of the stored files at which service and id fall below those of the row before."""
    table = LogTable(spark, scratch(spark, "logs"))
    table.append(logs_of(spark, sf_dir))
    rows = table.read().select("week_start", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.struct("service", "id").alias("here"))
    after = rows.select("file", (F.col("at") - 1).alias("at"), F.col("here").alias("next"))
    return rows.join(after, ["file", "at"], "left").groupBy(F.col("week_start").cast("string").alias("week_start")).agg(F.count("*").alias("n"), F.count_if(F.col("next") < F.col("here")).alias("out_of_order"))


@query("seeded_source", """SELECT ['debug', 'info', 'warn', 'error'][1 + n % 4] AS level, ['api', 'auth', 'billing', 'cart', 'mail', 'search', 'stock', 'web'][1 + n % 8] AS service, count(*) AS n FROM (SELECT unnest(range(1, 2001)) AS n) GROUP BY ALL""")
def _seeded(spark, sf_dir):
    return seeded(spark, 2000).groupBy("level", "service").agg(F.count("*").alias("n"))


@query("stream_fold_equals_batch", "SELECT time_bucket(INTERVAL 10 SECONDS, ts, TIMESTAMP '1970-01-01') AS bucket_start, service, level, count(*) AS entry_count FROM logs GROUP BY ALL")
def _stream(spark, sf_dir):
    """Stores the rows, lets the stream fold them, in as many folds as it takes, and reads the pre-aggregate's totals."""
    engine = Engine(spark, scratch(spark, "stream"), clock=lambda: times.parse_iso(UNTIL))
    engine.adopt(logs_of(spark, sf_dir).withColumn("id", F.col("id") + 1))
    engine.follow().awaitTermination()
    return engine.rollup.totals()


from . import stored  # noqa: E402,F401  its queries register themselves
