"""Named queries over stored tables, generated logs, and what runs on the driver, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.predicates import all_of, time_range
from ..model import BadRequest, Settings
from ..operators import attrindex, page, retention, rollup, stats, validate
from ..operators.aggregate import answer, buckets
from ..sources.logs import LogTable, awkward
from ..streaming.admission import Gate, IngestFloor, Metrics, Reservoir
from ..streaming.ingest import Engine
from .catalog import BATCH, CUTOFF, CUTOFF_SQL, NOW, SINCE, UNALIGNED, UNTIL, logs_of, query, request, scratch, stored_rollup, stored_tokens
from .routing import AggregateRequest, plan

FOLDED = "SELECT time_bucket(INTERVAL {} SECONDS, ts, TIMESTAMP '1970-01-01') AS bucket_start, service, level, count(*) AS entry_count FROM logs {} GROUP BY ALL"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a fixed table."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({columns})"


def _n(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def _engine(spark: SparkSession, **settings) -> Engine:
    return Engine(spark, scratch(spark, "engine"), Settings(**settings), clock=lambda: times.parse_iso("2024-02-01"))


# --- writes that are under way


@query(
    "fold_beside_open_write",
    """SELECT * FROM (SELECT 'open' AS state, count(*) FILTER (id < n // 4) AS n_rollup, count(*) FILTER (id < n // 4 OR id >= n // 2) AS n_logs FROM logs, (SELECT count(*) AS n FROM logs)
UNION ALL SELECT 'half', count(*) FILTER (id < n // 4), count(*) FILTER (id < n // 4 OR id >= n // 2 OR id % 2 = 0) FROM logs, (SELECT count(*) AS n FROM logs) UNION ALL SELECT 'whole', count(*), count(*) FROM logs)""",
)
def _beside(spark, sf_dir):
    """A write of the second quarter of ids is under way, half visible, and at last whole, while later ids are there already."""
    engine, logs, n = _engine(spark), logs_of(spark, sf_dir), _n(spark, sf_dir)
    logs, low, high = logs.withColumn("id", F.col("id") + 1), n // 4 + 1, n // 2 + 1
    found = []

    def look(name):
        engine.fold()
        found.append((name, engine.rollup.read().agg(F.coalesce(F.sum("entry_count"), F.lit(0))).first()[0], engine.logs.read().count()))

    engine.adopt(logs.where(F.col("id") < low), "first")
    engine.reserve("slow", high - low, 0)
    engine.adopt(logs.where(F.col("id") >= high), "last")
    look("open")
    middle = logs.where((F.col("id") >= low) & (F.col("id") < high))
    engine.logs.append(middle.where("id % 2 = 1"))
    look("half")
    engine.logs.withdraw(low, high)
    engine.logs.append(middle)
    engine.finish("slow")
    look("whole")
    return spark.createDataFrame(found, "state string, n_rollup long, n_logs long")


@query("index_beside_open_write", "SELECT CAST(max(id) FILTER (id < n // 4) AS BIGINT) + 2 AS watermark_id, count(*) FILTER (id < n // 4) AS n FROM logs, (SELECT count(*) AS n FROM logs)")
def _index_beside(spark, sf_dir):
    engine, logs, n = _engine(spark, index_min_rows=100_000, index_max_rows=10**9), logs_of(spark, sf_dir), _n(spark, sf_dir)
    logs = logs.withColumn("id", F.col("id") + 1)
    engine.adopt(logs.where(F.col("id") <= n // 4), "first")
    engine.reserve("slow", 10, 0)
    engine.adopt(logs.where(F.col("id") > n // 4 + 10), "last")
    engine.fold()
    while engine.index():
        pass
    return engine.tokens.read().agg(F.lit(engine.tokens.state()["watermark_id"]).cast("long").alias("watermark_id"), F.count("*").alias("n"))


ENTRIES = [{"timestamp": f"2024-01-20T10:{i:02d}:00Z", "level": ("debug", "info", "warn", "error")[i % 4], "service": f"s{i % 3}", "message": f"m {i}"} for i in range(12)]


@query("ingest_stores_once", "SELECT CAST(id AS BIGINT) AS id, level, service, message FROM (" + values("id, level, service, message", [(i + 1, e["level"], e["service"], e["message"]) for i, e in enumerate(ENTRIES)]) + ")")
def _once(spark, sf_dir):
    """A batch, the same again, one that fails half way, and that again."""
    engine = _engine(spark)
    batch = lambda a, b: spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate([*ENTRIES[a:b], {"level": "info"}])], "index long, entry string")
    for _ in range(2):
        engine.write_batch(batch(0, 7), 0)
    engine.reserve("ingest-1", 5, engine.clock())
    validated = validate.accepted(validate.checked(batch(7, 12), engine.clock()))
    engine.logs.append(validated.withColumn("id", F.col("index") + 8).where("id % 2 = 0"))
    engine.write_batch(batch(7, 12), 1)
    return engine.logs.read().select("id", "level", "service", "message")


@query("adopted_rows_read_back", "SELECT id + 1 AS id, ts, level, service, message, attributes FROM logs WHERE id < 400")
def _adopted(spark, sf_dir):
    engine = _engine(spark)
    engine.adopt(logs_of(spark, sf_dir).where("id < 400").withColumn("id", F.col("id") + 1))
    return engine.logs.read().drop("week_start")


@query("reply_to_batch", values("status, accepted, rejected, first_reason", [(200, sum(r is None for _, r in BATCH[:10]), sum(r is not None for _, r in BATCH[:10]), next(r for _, r in BATCH[:10] if r))]))
def _reply(spark, sf_dir):
    _, reply, status = validate.process_body(spark, json.dumps({"logs": [e for e, _ in BATCH[:10]]}), times.parse_iso(NOW))
    return spark.createDataFrame([(status, reply["accepted"], len(reply["rejected"]), reply["rejected"][0]["reason"])], "status int, accepted int, rejected int, first_reason string")


# --- the pre-aggregate and the index as tables


@query("rollup_states", "SELECT fold, CAST(least(n, fold * 400) AS BIGINT) AS watermark_id, fold * 400 < n AS behind, CAST(least(400, n - (fold - 1) * 400) AS BIGINT) AS last_rows, fold * 400 >= n AS safe FROM (SELECT unnest(range(1, 4)) AS fold), (SELECT count(*) AS n FROM logs WHERE id < 1000)")
def _states(spark, sf_dir):
    """Three folds of at most 400 ids each, of the first 1000."""
    table, found = rollup.RollupTable(spark, scratch(spark, "rollup"), Settings(max_fold_rows=400)), []
    for i in (1, 2, 3):
        table.fold(logs_of(spark, sf_dir), below=min(1000, _n(spark, sf_dir)), now=times.parse_iso(UNTIL))
        s = table.state()
        found.append((i, s["watermark_id"], s["behind"], s["last_rows"], s["safe_before"] is not None))
    return spark.createDataFrame(found, "fold long, watermark_id long, behind boolean, last_rows long, safe boolean")


@query("rollup_rebuilt_60s", FOLDED.format(60, ""))
def _rebuilt(spark, sf_dir):
    logs, n = logs_of(spark, sf_dir), _n(spark, sf_dir)
    table = stored_rollup(spark, logs, n // 2)
    table.rebuild(60)
    while table.fold(logs, below=n) != rollup.NOTHING:
        pass
    return table.read().groupBy("bucket_start", "service", "level").agg(F.sum("entry_count").cast("long").alias("entry_count"))


@query("rollup_state_kept_by_readers", FOLDED.format(10, "WHERE id < (SELECT count(*) // 2 FROM logs)"))
def _snapshot(spark, sf_dir):
    """A reader that holds a state reads it whole while later folds and a compaction commit."""
    logs, n = logs_of(spark, sf_dir), _n(spark, sf_dir)
    table = stored_rollup(spark, logs, n // 2)
    state = table.state()
    table.fold(logs, below=n)
    table.compact()
    return table.read(state).groupBy("bucket_start", "service", "level").agg(F.sum("entry_count").cast("long").alias("entry_count"))


@query("retention_on_tables", f"SELECT * FROM (SELECT 'rows' AS what, count(*) AS n FROM logs WHERE ts >= {CUTOFF_SQL} UNION ALL SELECT 'rollup', count(*) FROM logs WHERE ts >= {CUTOFF_SQL} UNION ALL SELECT 'tokens', count(*) FROM logs WHERE ts >= {CUTOFF_SQL} UNION ALL SELECT 'weeks', count(DISTINCT date_trunc('week', ts)) FROM logs WHERE date_trunc('week', ts) + INTERVAL 7 DAYS > {CUTOFF_SQL})")
def _enforced(spark, sf_dir):
    logs, n = LogTable(spark, scratch(spark, "logs")), _n(spark, sf_dir)
    logs.append(logs_of(spark, sf_dir))
    counts, tokens = stored_rollup(spark, logs.read(), n), stored_tokens(spark, logs.read(), n)
    retention.enforce(logs, times.parse_iso(CUTOFF), counts, tokens)
    total = counts.read().agg(F.coalesce(F.sum("entry_count"), F.lit(0))).first()[0]
    return spark.createDataFrame([("rows", logs.read().count()), ("rollup", total), ("tokens", tokens.read().count()), ("weeks", len(logs.weeks()))], "what string, n long")


@query("hybrid_after_retention", f"SELECT strftime(time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, level AS \"group\", count(*) AS count FROM logs WHERE ts >= {CUTOFF_SQL} AND ts < TIMESTAMP '{UNTIL}' GROUP BY 1, 2")
def _hybrid_after(spark, sf_dir):
    logs, n = LogTable(spark, scratch(spark, "logs")), _n(spark, sf_dir)
    logs.append(logs_of(spark, sf_dir))
    counts = stored_rollup(spark, logs.read(), n * 3 // 4)
    retention.enforce(logs, times.parse_iso(CUTOFF), counts)
    return buckets(logs.read(), request("1h", group_by="level"), **counts.source())


@query("index_states", "SELECT CAST(n AS BIGINT) AS watermark_id, CAST(0 AS BIGINT) AS backlog, CAST(n AS BIGINT) AS rows_indexed, CAST(2 AS BIGINT) AS batches, TRUE AS timed FROM (SELECT count(*) AS n FROM logs)")
def _indexed(spark, sf_dir):
    logs, n = logs_of(spark, sf_dir), _n(spark, sf_dir)
    s = attrindex.snapshot(stored_tokens(spark, logs, n).state(), n - 1)
    timed = 0 < s["mean_ms"] <= s["peak_ms"] and s["p50_ms"] <= s["p95_ms"]
    return spark.createDataFrame([(int(s["watermark_id"]), s["backlog"], s["rows_indexed"], s["batches"], timed)], "watermark_id long, backlog long, rows_indexed long, batches long, timed boolean")


@query("stored_weeks", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_start, count(*) AS rows, min(id) AS least_id, max(id) AS largest_id FROM logs GROUP BY 1")
def _weeks(spark, sf_dir):
    logs = LogTable(spark, scratch(spark, "logs"))
    logs.append(logs_of(spark, sf_dir))
    return logs.files().drop("files").withColumn("week_start", F.col("week_start").cast("string"))


@query("pruned_weeks", "SELECT count(DISTINCT date_trunc('week', ts)) FILTER (ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-16') AS opened, count(DISTINCT date_trunc('week', ts)) AS stored FROM logs")
def _pruned(spark, sf_dir):
    """Weeks whose files a scan of one week of time opens."""
    logs = LogTable(spark, scratch(spark, "logs"))
    logs.append(logs_of(spark, sf_dir))
    filters = time_range(times.parse_iso("2024-01-09"), times.parse_iso("2024-01-16") - 1, True)
    scan = logs.read().where(all_of(filters)).select("id")._jdf.queryExecution().executedPlan().collectLeaves().head()
    chosen = scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters())
    opened = {chosen.apply(i).values().toString() for i in range(chosen.length())}
    return spark.createDataFrame([(len(opened), len(logs.weeks()))], "opened long, stored long")


# --- awkward logs

AWKWARD = """awkward AS (SELECT n + 1 AS id, TIMESTAMP '2024-05-01' + to_microseconds(CASE WHEN n < 1800 THEN (n * 1103515245 + 12345) % 2147483647 % 360000000 WHEN n < 1806 THEN [0, 59999, 60000, 299999, 300000, 3599999][n - 1799]::BIGINT * 1000 WHEN n < 2106 THEN 123000000
  WHEN n < 2306 THEN 360000000 - (n - 2106) * 997000 ELSE (n * 1103515245 + 24690) % 2147483647 % 60000000 END) AS ts, ['debug', 'info', 'warn', 'error'][(n * 1103515245 + 37035) % 2147483647 % 4 + 1] AS level, 's' || ((n * 1103515245 + 49380) % 2147483647 % 3) AS service,
  CASE WHEN n % 3 = 0 THEN 'NeedleCase ' ELSE 'ordinary line ' END || n AS message, n FROM (SELECT unnest(range(2556)) AS n))"""
MAY = ("2024-05-01T00:00:00Z", "2024-05-01T02:00:00Z")


def may(bucket: str = "1m", since: str = MAY[0], until: str = MAY[1], **more) -> AggregateRequest:
    return request(bucket, since, until, **more)


def _bins(seconds: int, group: str, where: str = "TRUE") -> str:
    return f"WITH {AWKWARD} SELECT strftime(time_bucket(INTERVAL {seconds} SECONDS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, {group} AS \"group\", count(*) AS count FROM awkward WHERE {where} GROUP BY 1, 2"


@query("awkward_source", f"WITH {AWKWARD} SELECT id, ts, level, service, message FROM awkward")
def _awkward(spark, sf_dir):
    return awkward(spark).select("id", "ts", "level", "service", "message")


for _bucket, _seconds, _group in (("1m", 60, "service"), ("5m", 300, "level"), ("1h", 3600, "service")):

    @query(f"awkward_late_hybrid_{_bucket}", _bins(_seconds, _group))
    def _late(spark, sf_dir, b=_bucket, g=_group):
        """The first minute is folded, then late rows come into it and stay unfolded."""
        logs = awkward(spark).drop("part")
        return buckets(logs, may(b, group_by=g), **stored_rollup(spark, logs, 2307).source())


@query("awkward_late_folded", _bins(60, "level"))
def _late_folded(spark, sf_dir):
    """Late rows are folded into bins that were folded before."""
    logs = awkward(spark).drop("part")
    table = stored_rollup(spark, logs, 2307)
    table.fold(logs, below=2557)
    table.compact()
    return buckets(logs.limit(0), may(group_by="level"), **table.source())


for _i, (_since, _until) in enumerate((("00:00:00", "01:00:00"), ("00:00:07.000451", "00:04:59.99995"), ("00:00:10.0004", "00:00:20.0004"), ("00:00:03", "00:00:09"), ("00:00:05", "00:00:05"), ("00:01:00", "00:02:00"))):

    @query(f"awkward_range_{_i}", f"WITH {AWKWARD} SELECT '{_since} {_until}' AS range, count(*) AS rows FROM awkward WHERE ts >= TIMESTAMP '2024-05-01 {_since}' AND ts < TIMESTAMP '2024-05-01 {_until}'")
    def _range(spark, sf_dir, a=_since, b=_until):
        logs = awkward(spark).drop("part")
        found, _ = answer(logs, may("1m", f"2024-05-01T{a}Z", f"2024-05-01T{b}Z"), **stored_rollup(spark, logs, 1500).source())
        return spark.createDataFrame([(f"{a} {b}", sum(r["count"] for r in found))], "range string, rows long")


for _name, _attrs, _where in (
    ("flag", {"flag": "true"}, "n % 2 = 0"),
    ("count", {"count": "7"}, "n = 7"),
    ("ratio", {"ratio": "0.25"}, "n = 1"),
    ("text_and_flag", {"shard": "3", "flag": "false"}, "n % 7 = 3 AND n % 2 = 1"),
    ("collision", {"collision": "yes", "run": "r1"}, "n >= 1806 AND n < 2106"),
):

    @query(f"awkward_attr_{_name}", f"WITH {AWKWARD} SELECT id FROM awkward WHERE {_where} ORDER BY ts DESC, id DESC LIMIT 1000")
    def _typed(spark, sf_dir, a=_attrs):
        """A page by typed attributes, from tokens below the watermark and rows above."""
        logs = awkward(spark).drop("part")
        return page.two_source_page(logs, stored_tokens(spark, logs, 2000).read(), 2000, page.PageRequest(attributes=a, limit=1000)).select("id")


@query("awkward_needle", f"WITH {AWKWARD} SELECT CAST(id AS VARCHAR) AS id, message FROM awkward WHERE contains(lower(message), 'needlecase 1') ORDER BY ts DESC, id DESC LIMIT 100")
def _needle(spark, sf_dir):
    return page.page(awkward(spark).drop("part"), page.PageRequest(q="nEEDLEcASE 1")).select("id", "message")


@query("awkward_walk", f"WITH {AWKWARD} SELECT row_number() OVER (ORDER BY ts DESC, id DESC) AS pos, id FROM awkward QUALIFY pos <= 900")
def _walked(spark, sf_dir):
    """Three pages of 300 by cursors, through rows of one instant."""
    logs, rows, cursor = awkward(spark).drop("part"), [], None
    for _ in range(3):
        got, token = page.query(logs, page.PageRequest(limit=300, cursor=cursor))
        rows += [int(r["id"]) for r in got]
        cursor = page.decode_cursor(token)
    return spark.createDataFrame(list(enumerate(rows, 1)), "pos long, id long")


# --- replies, requests and settings


@query("count_reply", "SELECT row_number() OVER (ORDER BY start, \"group\") - 1 AS pos, * FROM (SELECT strftime(time_bucket(INTERVAL 86400 SECONDS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, service AS \"group\", count(*) AS count FROM logs GROUP BY 1, 2)")
def _count_reply(spark, sf_dir):
    found, _ = answer(logs_of(spark, sf_dir), request("1d", group_by="service"))
    return spark.createDataFrame([(i, r["start"], r["group"], r["count"]) for i, r in enumerate(found)], "pos long, start string, group string, count long")


@query("page_reply", "SELECT row_number() OVER (ORDER BY ts DESC, logs.id DESC) AS pos, CAST(id AS VARCHAR) AS id, json_extract_string(attributes, '$.k') AS k, epoch_us(ts) AS us FROM logs WHERE level = 'warn' ORDER BY ts DESC, logs.id DESC LIMIT 25")
def _page_reply(spark, sf_dir):
    """What a page's reply holds, and the instant of each row's cursor."""
    found, cursors, cursor = [], [], None
    logs = logs_of(spark, sf_dir).where("level = 'warn'")
    for _ in range(5):
        rows, token = page.query(logs, page.PageRequest(limit=5, cursor=cursor))
        found += rows
        cursor = page.decode_cursor(token)
        cursors.append(cursor)
    us = {str(r.id): times.to_micros(r.ts) for r in logs.select("id", "ts").where(F.col("id").isin([int(r["id"]) for r in found])).collect()}
    ends = {str(i): at for at, i in cursors}
    return spark.createDataFrame([(i, r["id"], str(r["attributes"]["k"]), ends.get(r["id"], us[r["id"]])) for i, r in enumerate(found, 1)], "pos long, id string, k string, us long")


def _reason(parse, params: dict) -> str:
    try:
        parse(params)
    except BadRequest as e:
        return str(e)
    return "accepted"


# Parameters of requests and what is wrong with them.
PAGES = (
    ({}, "accepted"),
    ({"limit": "1000", "service": "a", "level": "info", "q": "x", "attr.a.b": "c"}, "accepted"),
    ({"limit": ["1", "2"]}, "accepted"),
    ({"service": ""}, "service must be a non-empty string"),
    ({"level": "fatal"}, "level must be one of debug, info, warn, error"),
    ({"since": "soon"}, "since must be a valid ISO 8601 timestamp"),
    ({"until": "2024-13-01"}, "until must be a valid ISO 8601 timestamp"),
    ({"since": "2024-01-02", "until": "2024-01-01"}, "until must not be earlier than since"),
    ({"limit": "0"}, "limit must be between 1 and 1000"),
    ({"limit": "1001"}, "limit must be between 1 and 1000"),
    ({"limit": "-1"}, "limit must be a positive integer"),
    ({"limit": "1.5"}, "limit must be a positive integer"),
    ({"q": ""}, "q must be a non-empty string"),
    ({"attr.": "x"}, "attribute filter key must not be empty"),
    ({"attr.a": ["x", "y"]}, "attribute filter attr.a must have a single value"),
    ({"cursor": "!!"}, "cursor is invalid or malformed"),
)
GOOD = {"since": "2024-01-01", "until": "2024-01-01", "bucket": "1m"}
COUNTS = ((GOOD, True), (GOOD | {"group_by": "level"}, True), (GOOD | {"bucket": "2m"}, False), (GOOD | {"group_by": "message"}, False), (GOOD | {"until": "2023"}, False), ({"until": "2024", "bucket": "1m"}, False), (GOOD | {"until": "2023-12-31"}, False), (GOOD | {"level": "x"}, False), (GOOD | {"bucket": None}, False))


@query("page_requests", values('"case", reason', [(i, r) for i, (_, r) in enumerate(PAGES)]))
def _page_requests(spark, sf_dir):
    return spark.createDataFrame([(i, _reason(page.PageRequest.parse, p)) for i, (p, _) in enumerate(PAGES)], "case int, reason string")


@query("count_requests", values('"case", accepted', list(enumerate(ok for _, ok in COUNTS))))
def _count_requests(spark, sf_dir):
    parse = lambda p: AggregateRequest.parse({k: v for k, v in p.items() if v is not None})
    return spark.createDataFrame([(i, _reason(parse, p) == "accepted") for i, (p, _) in enumerate(COUNTS)], "case int, accepted boolean")


# Requests (since and until in seconds of a day, search, stored width, watermark) and their plan's path and cost.
PLANS = ((0, 60, None, 10, 100, "hybrid", "bounded"), (3, 9, None, 10, 100, "raw", "bounded"), (0, 0, None, 10, 100, "raw", "bounded"), (0, 60, "x", 10, 100, "raw", "scan"), (0, 60, None, 10, 0, "raw", "bounded"), (0, 60, None, 45, 100, "raw", "bounded"), (5, 65, None, 10, 100, "hybrid", "bounded"))


@query("routing_plans", values('"case", path, cost', [(i, p[5], p[6]) for i, p in enumerate(PLANS)]))
def _plans(spark, sf_dir):
    base = times.parse_iso(SINCE)
    reqs = [AggregateRequest(base + a * times.SECOND, base + b * times.SECOND, "1m", q=q) for a, b, q, *_ in PLANS]
    return spark.createDataFrame([(i, plan(r, p[4], p[3]).path, r.cost) for i, (r, p) in enumerate(zip(reqs, PLANS, strict=True))], "case int, path string, cost string")


@query("rollup_answer_reads_no_rows", "SELECT count(*) AS counted, CAST(0 AS BIGINT) AS raw_rows, 'rollup' AS path FROM logs")
def _no_rows(spark, sf_dir):
    """An answer by the pre-aggregate from a log table that could not be read at all."""
    logs, n = logs_of(spark, sf_dir), _n(spark, sf_dir)
    source = stored_rollup(spark, logs, n).source()
    found, path = answer(logs.where(F.col("id") >= n), request("1d"), **source)  # the raw branch asks for ids from the watermark on, and nothing else
    return spark.createDataFrame([(sum(r["count"] for r in found), 0 if path == "rollup" else 1, path)], "counted long, raw_rows long, path string")


SETTINGS = (({}, True), ({"LOGWEIR_ROLLUP_WIDTH": "30"}, True), ({"LOGWEIR_ROLLUP_WIDTH": "7"}, False), ({"LOGWEIR_RETENTION_DAYS": "0"}, False), ({"LOGWEIR_RETENTION_DAYS": "x"}, False), ({"LOGWEIR_INDEX_MIN_ROWS": "500000"}, False), ({"LOGWEIR_MAX_FOLD_ROWS": "-5"}, False))


@query("settings_checked", values('"case", accepted', list(enumerate(ok for _, ok in SETTINGS))))
def _settings(spark, sf_dir):
    def accepted(env):
        try:
            return bool(Settings.from_env(env))
        except ValueError:
            return False

    return spark.createDataFrame([(i, accepted(e)) for i, (e, _) in enumerate(SETTINGS)], "case int, accepted boolean")


@query("instants", "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, epoch_us(time_bucket(INTERVAL 10 SECONDS, ts, TIMESTAMP '1970-01-01')) AS floor, epoch_us(time_bucket(INTERVAL 10 SECONDS, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01')) + 10000000 AS ceil FROM logs WHERE id < 200")
def _instants(spark, sf_dir):
    rows = logs_of(spark, sf_dir).where("id < 200").select("id", "ts").collect()
    at = {r.id: times.to_micros(r.ts) for r in rows}
    assert all(times.parse_iso(times.iso(us)) == us for us in at.values())
    return spark.createDataFrame([(i, times.iso(us), times.floor_to(us, 10), times.ceil_to(us, 10)) for i, us in at.items()], "id long, iso string, floor long, ceil long")


@query("cursors_keep_microseconds", "SELECT id, epoch_us(ts) AS us FROM logs WHERE id % 50 = 0 AND id < 5000")
def _cursors(spark, sf_dir):
    rows = logs_of(spark, sf_dir).where("id % 50 = 0 and id < 5000").select("id", "ts").collect()
    found = [page.decode_cursor(page.encode_cursor(times.to_micros(r.ts), r.id)) for r in rows]
    return spark.createDataFrame([(i, us) for us, i in found], "id long, us long")


# --- the shape matrix of counts: widths by groups, filters, ranges


def _where(req: AggregateRequest) -> str:
    parts = [f"ts >= TIMESTAMP '{times.from_micros(req.since)}'", f"ts < TIMESTAMP '{times.from_micros(req.until)}'"]
    parts += [f"service = '{req.service}'"] if req.service else []
    parts += [f"level = '{req.level}'"] if req.level else []
    parts += [f"contains(lower(message), '{req.q.lower()}')"] if req.q else []
    return " AND ".join([*parts, *(f"json_extract_string(attributes, '$.{k}') = '{v}'" for k, v in req.attributes.items())])


SHAPES = [request(b, group_by=g) for b in ("1m", "5m", "1h", "1d") for g in (None, "service", "level")]
SHAPES += [request("1h", **f) for f in ({"service": "svc-2"}, {"level": "info"}, {"service": "svc-2", "level": "info"}, {"q": "error"}, {"q": "zzz"}, {"attributes": {"k": "5"}}, {"attributes": {"k": "5"}, "service": "svc-1"}, {"q": "click", "level": "debug"}, {"service": "none"}, {"q": "USER 1", "group_by": "service"})]
SHAPES += [request(b, f"2024-01-10T{a}Z", f"2024-01-{d}Z") for b in ("1m", "1h") for a, d in (("00:00:00", "10T06:00:00"), ("00:00:00", "11T00:00:00"), ("05:17:03.5", "10T23:41:59.25"))]
SHAPES += [request("1m", *r) for r in (UNALIGNED, (SINCE, SINCE), ("2024-01-31", UNTIL))]


@query("count_shapes", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS shape, count(*) AS buckets, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM logs WHERE {_where(r)} GROUP BY time_bucket(INTERVAL {r.seconds} SECONDS, ts, TIMESTAMP '1970-01-01'){', ' + r.group_by if r.group_by else ''})" for i, r in enumerate(SHAPES)))
def _shapes(spark, sf_dir):
    """Each shape by a half folded pre-aggregate where it may be used: how many buckets, and their sum."""
    logs = logs_of(spark, sf_dir)
    source = stored_rollup(spark, logs, _n(spark, sf_dir) // 2).source()
    out: DataFrame | None = None
    for i, r in enumerate(SHAPES):
        one = buckets(logs, r, **source).agg(F.lit(i).alias("shape"), F.count("*").alias("buckets"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


# --- figures of what runs


@query("amplification", values("rows_written, writes_per_1000, transactions_per_1000, rows_per_write", [(2000, "2.0", "1.0", "500.0"), (0, "0.0", "0.0", "0.0")]).replace("'", ""))
def _amplification(spark, sf_dir):
    found = [(n, stats.amplification(n, w, t)) for n, w, t in ((2000, 4, 2), (0, 0, 0))]
    return spark.createDataFrame([(n, a["writes_per_1000"], a["transactions_per_1000"], a["rows_per_write"]) for n, a in found], "rows_written int, writes_per_1000 double, transactions_per_1000 double, rows_per_write double")


@query("index_batch_sizes", values("took_ms, next_rows", [(10, 1300), (39, 1300), (40, 1000), (120, 1000), (121, 600), (360, 600), (361, 200)]))
def _sizes(spark, sf_dir):
    return spark.createDataFrame([(ms, attrindex.next_batch_rows(1000, ms, Settings())) for ms in (10, 39, 40, 120, 121, 360, 361)], "took_ms int, next_rows int")


@query("ingest_floor", values("at_second, floor", [(2, 3), (11, 3), (13, 3), (14, 7), (15, -1)]))
def _floor(spark, sf_dir):
    floor = IngestFloor()
    for oldest, second in ((5, 1), (3, 2), (7, 3)):
        floor.note(oldest, second * times.SECOND)
    at = lambda s: floor.floor(s * times.SECOND)
    return spark.createDataFrame([(s, -1 if at(s) is None else at(s)) for s in (2, 11, 13, 14, 15)], "at_second int, floor int")


@query("latency_reservoir", "WITH k AS (SELECT list_sort(list(user_id)) AS xs FROM (SELECT user_id FROM events ORDER BY event_id DESC LIMIT 4096)) SELECT CAST(len(xs) AS BIGINT) AS count, xs[least(len(xs) - 1, 50 * len(xs) // 100) + 1]::DOUBLE AS p50, xs[least(len(xs) - 1, 95 * len(xs) // 100) + 1]::DOUBLE AS p95, xs[least(len(xs) - 1, 99 * len(xs) // 100) + 1]::DOUBLE AS p99 FROM k")
def _reservoir(spark, sf_dir):
    """The driver's reservoir, fed with the users of the last events."""
    reservoir = Reservoir()
    for r in reversed(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").orderBy(F.desc("event_id")).limit(5000).collect()):
        reservoir.record(float(r.user_id))
    p = reservoir.percentiles()
    return spark.createDataFrame([(p["count"], float(p["p50"]), float(p["p95"]), float(p["p99"]))], "count long, p50 double, p95 double, p99 double")


@query("lanes_and_traces", values("name, traces, stages", [("count raw", 2, "run_ms,wait_ms"), ("page", 1, "run_ms")]))
def _lanes(spark, sf_dir):
    gate, metrics = Gate(), Metrics()
    for name, lane in (("count", "bounded"), ("count", "scan"), ("page", None)):
        with metrics.timed(name, **({"path": "raw"} if lane else {})) as trace:
            if lane:
                with gate.admitted(lane) as trace["wait_ms"]:
                    pass
            with metrics.stage(trace, "run"):
                pass
    found = metrics.decomposition()
    return spark.createDataFrame([(k, v["traces"], ",".join(sorted(c for c in v if c not in ("traces", "ms", "other_ms")))) for k, v in found.items()], "name string, traces int, stages string")
