"""Pages, counts, folds, index, retention and streams on generated logs."""

import itertools
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from logweir.functions import times
from logweir.model import LOGS, BadRequest, Settings
from logweir.operators import attrindex, page, retention, rollup, stats, validate
from logweir.operators.aggregate import answer, buckets
from logweir.plans.routing import AggregateRequest, plan
from logweir.sources.logs import LogTable, entries, seeded
from logweir.streaming.admission import CachedState, Gate, IngestFloor, Metrics
from logweir.streaming.ingest import Engine

BASE = times.parse_iso("2024-05-01T00:00:00Z")
LEVELS = ("debug", "info", "warn", "error")


def frame(spark, rows):
    """rows: (id, offset in us, level, service, message, attributes)."""
    return spark.createDataFrame([(i, times.from_micros(BASE + o), lv, s, m, json.dumps(a)) for i, o, lv, s, m, a in rows], LOGS).coalesce(2).cache()


@pytest.fixture(scope="module")
def contract(spark):
    """250 rows with five-way ties on the timestamp."""
    return frame(spark, [(i + 1, i // 5 * times.SECOND, LEVELS[i % 4], "svc", f"NeedleCase {i}" if i % 3 == 0 else f"ordinary line {i}", {"run": "r", "bucket": str(i % 7), "flag": i % 2 == 0, "count": i}) for i in range(250)])


@pytest.fixture(scope="module")
def messy(spark):
    """Random rows over six minutes, edges of bins, a collision, rows in reverse, and microseconds."""
    rng = random.Random(5)
    rows = [(rng.randrange(360 * times.SECOND), rng.choice(LEVELS), f"s{rng.randrange(3)}") for _ in range(600)]
    rows += [(o * 1000, "info", "s0") for o in (0, 59_999, 60_000, 299_999, 300_000, 3_599_999)]
    rows += [(123 * times.SECOND, "warn", "s1")] * 120
    rows += [(360 * times.SECOND - 997_000 * i, "error", "s2") for i in range(150)]
    rng.shuffle(rows)
    return frame(spark, [(i, o, lv, s, "m", {"collision": "yes"} if o == 123 * times.SECOND else {}) for i, (o, lv, s) in enumerate(rows)])


def test_golden_counts(contract):
    req = lambda **k: AggregateRequest(BASE, BASE + 3600 * times.SECOND, "1d", **k)
    total = lambda r: sum(b["count"] for b in answer(contract, r)[0])
    assert total(req(level="error")) == 62
    assert total(req(q="needlecase")) == 84
    assert total(req(q="%")) == 0
    assert total(req(attributes={"flag": "true"})) == 125
    assert total(req(attributes={"count": "7"})) == 1


def walk(logs, req, **source):
    rows, cursor = [], None
    while True:
        got, token = page.query(logs, page.PageRequest(**{**req, "cursor": cursor}), **source)
        rows += got
        if token is None:
            return rows
        assert len(got) == req.get("limit", 100)
        cursor = page.decode_cursor(token)


@pytest.mark.parametrize("limit", [50, 125])
def test_walk_returns_every_row_once_in_order(contract, limit):
    rows = walk(contract, {"limit": limit})
    assert [int(r["id"]) for r in rows] == [r.id for r in contract.orderBy(F.desc("ts"), F.desc("id")).collect()]
    assert rows[0]["attributes"]["count"] == int(rows[0]["id"]) - 1


def test_walk_keeps_rows_within_a_millisecond(spark):
    logs = frame(spark, [(i, i * 7, "info", "s", "m", {}) for i in range(30)])
    assert [int(r["id"]) for r in walk(logs, {"limit": 4})] == list(range(29, -1, -1))


@pytest.mark.parametrize("watermark", [0, 120, 251])
def test_two_sources_answer_as_rows_do(contract, watermark):
    tokens = attrindex.indexed(contract, 0, watermark)
    req = {"attributes": {"bucket": "3", "flag": "true"}, "limit": 7}
    assert walk(contract, req, tokens=tokens, watermark=watermark) == walk(contract, req)


def test_hybrid_equals_raw(messy):
    n = messy.count()
    ranges = [(0, 3600_000_000), (7_000_451, 299_999_950), (10_000_400, 20_000_400), (3_000_000, 9_000_000), (5_000_000, 5_000_000), (60_000_000, 120_000_000)]
    stored = rollup.folded(messy, 0, n // 2).cache()
    for bucket, group, (a, b) in [*itertools.product(("1m", "5m", "1h", "1d"), (None, "service"), ranges[:2]), *((x, "level", r) for x in ("1m", "1h") for r in ranges[2:])]:
        req = AggregateRequest(BASE + a, BASE + b, bucket, group)
        assert answer(messy, req, rollup=stored, watermark=n // 2)[0] == answer(messy, req)[0]


def test_paths_of_unaligned_ranges():
    s = times.SECOND
    path = lambda a, b, **k: plan(AggregateRequest(BASE + a, BASE + b, "1m", **k), 100, 10).path
    assert path(0, 60 * s) == "hybrid" and path(3 * s, 9 * s) == "raw" and path(0, 0) == "raw"
    assert path(0, 60 * s, q="x") == "raw" and path(0, 60 * s, attributes={"a": "b"}) == "raw"
    assert plan(AggregateRequest(BASE, BASE + 60 * s, "1m"), 0, 10).path == "raw"
    assert plan(AggregateRequest(BASE, BASE + 60 * s, "1m"), 100, 45).path == "raw"
    found = plan(AggregateRequest(BASE + 1, BASE + 60 * s + 400, "1m"), 100, 10)
    assert found.rollup == (BASE + 10 * s, BASE + 60 * s) and [r.min_id for r in found.raw] == [None, 100, None]


def test_fold_is_incremental_idempotent_and_survives_a_crash(spark, messy, tmp_path):
    table = rollup.RollupTable(spark, str(tmp_path / "r"), Settings(max_fold_rows=300))
    n = messy.count()
    req = AggregateRequest(BASE, BASE + 3600 * times.SECOND, "1m", "service")
    want = answer(messy, req)[0]
    while "folded" in table.fold(messy, now=BASE):
        assert answer(messy, req, **table.source())[0] == want
    state = table.state()
    assert state["watermark_id"] == n and not state["behind"] and state["refreshes"] == -(-n // 300)
    assert table.fold(messy) == "nothing to fold" and table.state() == state
    rollup.folded(messy, 0, 50).write.parquet(str(tmp_path / "r" / "delta-lost"))  # a fold that died before its commit
    assert answer(messy, req, **table.source()) == (want, "rollup")
    table.compact()
    assert table.purge() > 1 and answer(messy, req, **table.source())[0] == want
    late = frame(spark, [(n + i, 60 * times.SECOND + i, "info", "s0", "late", {}) for i in range(40)])
    both = messy.unionByName(late)
    want = answer(both, req)[0]
    assert answer(both, req, **table.source()) == (want, "hybrid")
    table.fold(both)
    assert answer(both, req, **table.source()) == (want, "rollup")
    table.rebuild(30)
    assert table.state()["watermark_id"] == 0


def test_retention_uses_one_cutoff_everywhere(spark, tmp_path):
    logs = seeded(spark, 1500, days=20).cache()
    table, counts = LogTable(spark, str(tmp_path / "logs")), rollup.RollupTable(spark, str(tmp_path / "rollup"))
    tokens = attrindex.TokenTable(spark, str(tmp_path / "tokens"), Settings(index_min_rows=5000))
    table.append(logs)
    counts.fold(table.read().where("id < 1200"), first_id=1)
    tokens.index(table.read(), 1200)
    at = times.parse_iso("2024-01-10T13:00:03.25Z")
    done = retention.enforce(table, at, counts, tokens)
    assert done == {"cutoff": at, "dropped": ["2024-01-01"], "cut": "2024-01-08"}
    kept = table.read()
    assert kept.count() == logs.where(F.col("ts") >= times.at(at)).count()
    assert kept.where(F.col("ts") < times.at(at)).count() == 0
    req = AggregateRequest(times.parse_iso("2024-01-01"), times.parse_iso("2024-02-01"), "1h", "level")
    assert answer(kept, req, **counts.source())[0] == answer(kept, req)[0]
    assert tokens.read().count() == kept.where("id < 1200").count()
    assert sorted(table.weeks()) == ["2024-01-08", "2024-01-15"]


def test_validation_reply(spark):
    from logweir.plans.catalog import BATCH, NOW

    now = times.parse_iso(NOW)
    good, reply, status = validate.process_body(spark, json.dumps({"logs": [e for e, _ in BATCH[:10]]}), now)
    assert status == 200 and reply["accepted"] == 1 and [r["index"] for r in reply["rejected"]] == list(range(1, 10))
    row = good.first()
    assert times.to_micros(row.ts) == times.parse_iso("2024-06-01T11:59:00.123456Z")
    assert json.loads(row.attributes) == {"s": "x", "n": 3, "b": True, "f": 1.5, "neg": -2}
    assert validate.process_body(spark, '{"logs": []}', now)[2] == 400
    for bad in ("[]", "{", '{"logs": 1}'):
        with pytest.raises(BadRequest):
            validate.process_body(spark, bad, now)


def test_hostile_texts_survive(spark):
    text = "q\"uote \\back\t\n\r ünïcode 日本語 😀 العربية '; DROP TABLE logs; --"
    entry = {"timestamp": "2024-06-01T00:00:00+0130", "level": "info", "service": text, "message": text + "\0", "attributes": {text: text, "e": "-1.5e10", "big": 1e21, "whole": 2.0, "long": "x" * 5000}}
    row = validate.accepted(validate.checked(entries(spark, [json.dumps(entry)]), times.parse_iso("2024-06-02"))).first()
    assert row.service == text and row.message == text
    found = json.loads(row.attributes)
    assert found[text] == text and found["e"] == "-1.5e10" and found["whole"] == 2 and found["long"] == "x" * 5000
    assert times.to_micros(row.ts) == times.parse_iso("2024-05-31T22:30:00Z")


@pytest.mark.parametrize(
    ("params", "reason"),
    [
        ({"service": ""}, "service must be a non-empty string"),
        ({"level": "fatal"}, "level must be one of debug, info, warn, error"),
        ({"since": "soon"}, "since must be a valid ISO 8601 timestamp"),
        ({"since": "2024-01-02", "until": "2024-01-01"}, "until must not be earlier than since"),
        ({"limit": "0"}, "limit must be between 1 and 1000"),
        ({"limit": "-1"}, "limit must be a positive integer"),
        ({"q": ""}, "q must be a non-empty string"),
        ({"attr.": "x"}, "attribute filter key must not be empty"),
        ({"attr.a": ["x", "y"]}, "attribute filter attr.a must have a single value"),
        ({"cursor": "!!"}, "cursor is invalid or malformed"),
        ({"cursor": page.encode_cursor(0, 2**64)}, "cursor is invalid or malformed"),
    ],
)
def test_bad_page_requests(params, reason):
    with pytest.raises(BadRequest, match=reason.replace(".", r"\.")):
        page.PageRequest.parse(params)


def test_requests():
    assert page.PageRequest.parse({"limit": ["1", "2"], "attr.a.b": "c"}) == page.PageRequest(attributes={"a.b": "c"})
    assert page.decode_cursor(page.encode_cursor(BASE + 1, 9)) == (BASE + 1, 9)
    good = {"since": "2024-01-01", "until": "2024-01-01", "bucket": "1m"}
    assert AggregateRequest.parse(good).seconds == 60
    for bad in ({"since": None}, {"bucket": "2m"}, {"group_by": "message"}, {"until": "2023"}):
        with pytest.raises(BadRequest):
            AggregateRequest.parse({k: v for k, v in (good | bad).items() if v is not None})


def test_times():
    for text, us in (("1970-01-01", 0), ("1970-01-01T00:00:00.0000015Z", 1), ("1970-01-01T01:00+01:00", 0), ("1969-12-31T23:59:59.999999Z", -1)):
        assert times.parse_iso(text) == us
    for bad in ("", "T10:00", "2024-13-01", "2024-01-01T25:00", "01/02/2024", "2024-01-01T00:00:00+24:00"):
        assert times.parse_iso(bad) is None
    assert times.ceil_to(1, 10) == 10 * times.SECOND and times.floor_to(-1, 10) == -10 * times.SECOND


def test_labels_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.range(1).select(times.page_label(times.at(times.parse_iso("2024-03-10T02:30:00.0451Z"))).alias("p"), times.bucket_label(times.at(0)).alias("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row.p, row.b) == ("2024-03-10T02:30:00.045Z", "1970-01-01T00:00:00Z")


def test_stream_stores_once_and_folds_late_rows(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    now = times.parse_iso("2024-06-01T12:00:00Z")
    engine = Engine(spark, str(tmp_path / "store"), Settings(index_min_rows=1000), clock=lambda: now)
    entry = lambda i, day: json.dumps({"timestamp": f"2024-05-{day:02d}T10:00:{i % 60:02d}Z", "level": LEVELS[i % 4], "service": f"s{i % 3}", "message": f"m {i}", "attributes": {"i": i}})
    (inbox / "1.json").write_text("\n".join([entry(i, 20) for i in range(90)] + ["broken"]))
    engine.ingest(str(inbox)).awaitTermination()
    engine.follow().awaitTermination()
    (inbox / "2.json").write_text("\n".join(entry(i, 3) for i in range(40)))  # late
    engine.ingest(str(inbox)).awaitTermination()
    logs = engine.logs.read()
    req = AggregateRequest(times.parse_iso("2024-05-01"), times.parse_iso("2024-06-01"), "1h", "service")
    want, path = answer(logs, req)[0], answer(logs, req, **engine.rollup.source())
    assert path == (want, "hybrid") and sum(b["count"] for b in want) == 130
    engine.follow().awaitTermination()
    assert answer(engine.logs.read(), req, **engine.rollup.source()) == (want, "rollup")
    assert sorted(r.id for r in engine.logs.read().select("id").collect()) == list(range(1, 131))
    engine.write_batch(spark.createDataFrame([(0, entry(1, 5))], "index long, entry string"), 77)
    engine.write_batch(spark.createDataFrame([(0, entry(1, 5))], "index long, entry string"), 77)  # comes again
    assert engine.logs.read().count() == 131
    assert engine.stats()["index"]["backlog"] >= 0 and engine.stats()["rollup"]["watermark_id"] == 131


def test_stream_folds_more_rows_than_one_fold_takes(spark, tmp_path):
    now = times.parse_iso("2024-06-01T12:00:00Z")
    engine = Engine(spark, str(tmp_path / "store"), Settings(max_fold_rows=25), clock=lambda: now)
    entries = [(i, json.dumps({"timestamp": "2024-05-20T10:00:00Z", "level": LEVELS[i % 4], "service": "s", "message": f"m {i}"})) for i in range(90)]
    engine.write_batch(spark.createDataFrame(entries, "index long, entry string"), 1)
    engine.follow().awaitTermination()
    assert engine.rollup.read().agg({"entry_count": "sum"}).first()[0] == 90
    state = engine.rollup.state()
    assert (state["watermark_id"], state["behind"], state["refreshes"]) == (91, False, 4)


def entry_rows(spark, n, first=0):
    rows = [(i, json.dumps({"timestamp": f"2024-05-20T10:{i % 60:02d}:00Z", "level": LEVELS[i % 4], "service": f"s{i % 3}", "message": f"m {i}", "attributes": {"i": i}})) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "index long, entry string")


def folded_rows(engine):
    return engine.rollup.read().agg(F.coalesce(F.sum("entry_count"), F.lit(0))).first()[0]


ALL_MAY = AggregateRequest(times.parse_iso("2024-05-01"), times.parse_iso("2024-06-01"), "1h", "service")


def test_a_slow_writer_is_waited_for(spark, tmp_path, monkeypatch):
    """Two writers: the first reserves ids and stores late, the second stores at once."""
    now = times.parse_iso("2024-06-01T12:00:00Z")
    engine = Engine(spark, str(tmp_path / "store"), clock=lambda: now)
    started, go_on = threading.Event(), threading.Event()
    append = engine.logs.append

    def slow(rows):
        if threading.current_thread().name == "slow":
            started.set()
            assert go_on.wait(120)
        append(rows)

    monkeypatch.setattr(engine.logs, "append", slow)
    first = threading.Thread(target=engine.write_batch, args=(entry_rows(spark, 30), 0, "slow"), name="slow")
    first.start()
    assert started.wait(120)
    engine.write_batch(entry_rows(spark, 20, 30), 0, "fast")
    engine.maintain()
    assert engine.settled() == 1 and folded_rows(engine) == 0 and engine.logs.read().count() == 20
    want = answer(engine.logs.read(), ALL_MAY)[0]
    assert answer(engine.logs.read(), ALL_MAY, **engine.rollup.source()) == (want, "raw")
    go_on.set()
    first.join()
    engine.maintain()
    assert engine.settled() == 51 and folded_rows(engine) == engine.logs.read().count() == 50
    assert engine.tokens.state()["watermark_id"] == 51
    ids = sorted(r.id for r in engine.logs.read().select("id").collect())
    assert ids == list(range(1, 51))


def test_a_half_visible_write_is_not_folded_and_comes_whole(spark, tmp_path, monkeypatch):
    clock = [times.parse_iso("2024-05-20T10:20:00Z")]
    engine = Engine(spark, str(tmp_path / "store"), clock=lambda: clock[0])
    engine.write_batch(entry_rows(spark, 10), 0, "a")
    batch = entry_rows(spark, 40, 10)  # half of them are too far ahead of the clock
    append = engine.logs.append

    def dies(rows):
        append(rows.where("id % 2 = 0"))
        raise OSError("lost")

    monkeypatch.setattr(engine.logs, "append", dies)
    with pytest.raises(OSError, match="lost"):
        engine.write_batch(batch, 0, "b")
    monkeypatch.undo()
    engine.write_batch(entry_rows(spark, 6), 1, "a")
    engine.maintain()
    assert engine.settled() == 11 and folded_rows(engine) == 10
    half = engine.logs.read().count()
    assert 16 < half
    clock[0] += 3600 * times.SECOND  # a later clock would accept more
    engine.write_batch(batch, 0, "b")  # comes again
    engine.write_batch(batch, 0, "b")  # and again, when it is whole
    engine.maintain()
    rows = engine.logs.read().collect()
    assert len({r.id for r in rows}) == len(rows) == folded_rows(engine) == 10 + 6 + 16
    assert sum(r.message in {f"m {i}" for i in range(10, 50)} for r in rows) == 16  # ten past to twenty-five past the hour
    row = engine.stats()
    assert row["ingest"]["open_writes"] == 0 and row["rollup"]["settled"] == engine.settled()


def test_an_abandoned_write_can_be_finished(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), clock=lambda: times.parse_iso("2024-06-01"))
    engine.reserve("gone-0", 100, 0)
    engine.write_batch(entry_rows(spark, 5), 0)
    engine.maintain()
    assert folded_rows(engine) == 0
    engine.finish("gone-0")
    engine.maintain()
    assert folded_rows(engine) == 5 and engine.settled() == 106


def test_adopted_rows_are_folded_and_keep_their_ids(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), clock=lambda: times.parse_iso("2024-01-02"))
    engine.adopt(seeded(spark, 200, days=1))
    engine.write_batch(entry_rows(spark, 3).limit(0), 0)
    engine.maintain()
    assert folded_rows(engine) == 200 and engine.settled() == 201
    with pytest.raises(ValueError, match="below the watermark"):
        engine.adopt(seeded(spark, 5))
    engine.adopt(seeded(spark, 5).limit(0), "nothing")


def test_commits_are_exclusive(spark, tmp_path):
    from logweir.operators.manifest import Manifest

    m = Manifest(spark, str(tmp_path / "m"), {"n": 0})
    m.commit(0, {"n": 1})
    with pytest.raises(FileExistsError):
        m.commit(0, {"n": 9})
    assert m.read() == (1, {"n": 1})
    errors = []

    def add():
        try:
            for _ in range(5):
                m.update(lambda s: {"n": s["n"] + 1})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    writers = [threading.Thread(target=add) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors and m.read()[1] == {"n": 21}
    assert m.update(lambda s: None) == {"n": 21}
    assert not [f for f in (tmp_path / "m" / "_manifests").iterdir() if f.name.endswith(".tmp")]


def test_retention_that_dies_anywhere_loses_nothing(spark, tmp_path, monkeypatch):
    from logweir.sources import files

    at = times.parse_iso("2024-01-10T13:00:03.25Z")
    logs = seeded(spark, 900, days=20).cache()
    kept = logs.where(F.col("ts") >= times.at(at)).count()
    table, counts, tokens = LogTable(spark, str(tmp_path / "logs")), rollup.RollupTable(spark, str(tmp_path / "rollup")), attrindex.TokenTable(spark, str(tmp_path / "tokens"), Settings(index_min_rows=5000))
    table.append(logs)
    counts.fold(table.read(), first_id=1)
    tokens.index(table.read(), 901)
    req = AggregateRequest(times.parse_iso("2024-01-01"), times.parse_iso("2024-02-01"), "1h", "level")
    for name in ("replace", "trim", "delete"):
        with monkeypatch.context() as m:

            def dies(*_, **__):
                raise OSError("killed")

            m.setattr({"replace": counts, "trim": tokens, "delete": files}[name], name, dies)
            with pytest.raises(OSError, match="killed"):
                retention.enforce(table, at, counts, tokens)
        assert table.read().count() == kept  # what is kept is there, whatever died
    table.append(seeded(spark, 30, days=1, start="2024-01-11").withColumn("id", F.col("id") + 900))  # late rows into the week that is cut
    assert retention.enforce(table, at, counts, tokens)["dropped"] == ["2024-01-01"]
    assert retention.enforce(table, at - 10**12, counts, tokens) == {"cutoff": at, "dropped": [], "cut": "2024-01-08"}  # never back
    rows = table.read()
    assert rows.count() == kept + 30
    assert answer(rows, req, **counts.source())[0] == answer(rows, req)[0]
    assert tokens.read().count() == kept
    counts.fold(rows)
    assert answer(rows, req, **counts.source()) == (answer(rows, req)[0], "rollup")


def test_engine_answers_through_lanes_and_keeps_figures(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), Settings(index_min_rows=1000), clock=lambda: times.parse_iso("2024-06-01"))
    assert engine.page({}) == ([], None)
    engine.write_batch(entry_rows(spark, 60), 0)
    span = {"since": "2024-05-20", "until": "2024-05-21", "bucket": "1h", "group_by": "service"}
    raw, path = engine.count(span)
    assert path == "raw" and sum(b["count"] for b in raw) == 60
    engine.maintain()
    engine.cached.until = float("-inf")
    assert engine.count(span) == (raw, "rollup")
    assert engine.count(span | {"q": "m 1"})[1] == "raw"
    assert [r["message"] for r in engine.page({"attr.i": "7"})[0]] == ["m 7"]
    assert len(engine.page({"q": "m 5", "limit": "50"})[0]) == 11
    stats = engine.stats()
    assert stats["metrics"]["counts"] == {"ingest": 1, "count": 3, "page": 3} and stats["metrics"]["latency"]["count"]["count"] == 3
    parts = stats["decomposition"]["count rollup"]
    assert parts["traces"] == 1 and parts["ms"] >= parts["run_ms"] > 0 and abs(parts["ms"] - sum(v for k, v in parts.items() if k not in ("traces", "ms"))) < 1e-6
    engine.cached.read, engine.cached.until = (lambda: 1 / 0), float("-inf")
    assert engine.count(span) == (raw, "raw")  # the state can't be read: rows answer


def test_indexer_defers_to_a_fold_and_takes_one_batch_when_busy(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), Settings(index_min_rows=7, index_max_rows=7))
    engine.write_batch(entry_rows(spark, 30), 0)
    engine.fold()
    with engine.folding:
        assert engine.index() == 0
    assert engine.tokens.state()["deferred"] == 1
    engine.gate.lanes["scan"].waiting.append(threading.Event())
    assert engine.index() == 7
    engine.gate.lanes["scan"].waiting.clear()
    while engine.index():
        pass
    assert engine.tokens.state()["watermark_id"] == 31
    number, state = engine.tokens.manifest.read()
    late = attrindex.TokenTable(spark, engine.tokens.path, engine.settings)
    late.manifest.read = lambda: (number - 1, state | {"watermark_id": 0})  # a writer that is behind
    late.manifest.update = lambda change: change(state)
    assert late.index(engine.logs.read(), 31) == -1


def test_two_sources_open_only_the_weeks_of_the_hits(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    logs = seeded(spark, 3000, days=28)
    table.append(logs)
    stored = table.read()
    tokens = attrindex.indexed(stored, 0, 3001)
    opened = []
    where = type(stored).where

    def spy(self, condition):
        out = where(self, condition)
        if "week_start" in self.columns:
            opened.append(out)
        return out

    type(stored).where = spy
    try:
        req = page.PageRequest(attributes={"region": "north", "retries": "3"}, limit=10)
        found = page.two_source_rows(stored, tokens, 3001, req)
    finally:
        type(stored).where = where
    assert [r.id for r in found] == [r.id for r in page.page_keys(stored, req).collect()] and len(found) == 11
    weeks = {r.w for r in opened[-1].select(F.col("week_start").alias("w")).distinct().collect()}
    assert len(weeks) < len(table.weeks())
    plan = opened[-1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_start" in plan and "GreaterThanOrEqual(ts" in plan


def test_two_sources_go_on_when_tokens_collide(contract):
    """Every row has the token of the wanted attribute, as if all hashes collided; the page is found none the less."""
    real = attrindex.indexed(contract, 0, 10**6)
    wanted = attrindex.indexed(contract.limit(1).withColumn("attributes", F.lit('{"count": 3}')), 0, 10**6).first().tokens
    collided = real.withColumn("tokens", F.array(*map(F.lit, wanted)))
    req = page.PageRequest(attributes={"count": "3"}, limit=2)
    assert [r.id for r in page.two_source_rows(contract, collided, 10**6, req)] == [4]


def test_index_controller_and_histogram():
    s = Settings()
    assert attrindex.next_batch_rows(1000, 10, s) == 1300 and attrindex.next_batch_rows(1000, 130, s) == 600
    assert attrindex.next_batch_rows(1000, 400, s) == s.index_min_rows and attrindex.next_batch_rows(1000, 60, s) == 1000
    assert attrindex.histogram_percentile([0, 0, 5, 4, 0, 0, 0, 1], 0.5) == 20
    assert attrindex.histogram_percentile([0] * 7 + [3], 0.95) == 320 and attrindex.histogram_percentile([0] * 8, 0.5) == 0


def test_settings():
    assert Settings.from_env({"LOGWEIR_ROLLUP_WIDTH": "30"}).rollup_width == 30
    for bad in ({"LOGWEIR_ROLLUP_WIDTH": "7"}, {"LOGWEIR_RETENTION_DAYS": "0"}, {"LOGWEIR_RETENTION_DAYS": "x"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)


def test_gate_hands_slots_on_in_order():
    gate, order, start = Gate(Settings(scan_slots=1)), [], threading.Event()

    def job(i):
        with gate.admitted("scan"):
            start.wait(5)
            order.append(i)

    jobs = []
    for i in range(4):
        jobs.append(threading.Thread(target=job, args=(i,)))
        jobs[-1].start()
        while len(gate.lanes["scan"].waiting) < i:
            pass
    start.set()
    for j in jobs:
        j.join()
    assert order == [0, 1, 2, 3]


def test_cached_state_and_metrics():
    clock, calls = [0.0], []

    def read():
        calls.append(1)
        if len(calls) == 2:
            raise OSError
        return len(calls)

    state = CachedState(read, 1.0, None, lambda: clock[0])
    assert (state.get(), state.get()) == (1, 1)
    clock[0] = 1.5
    assert state.get() is None
    metrics = Metrics()
    with metrics.timed("page", rows=3):
        pass
    assert metrics.snapshot()["counts"] == {"page": 1} and metrics.traces[0]["rows"] == 3
    floor = IngestFloor()
    floor.note(5, 1_000_000)
    floor.note(3, 2_000_000)
    assert floor.floor(2_000_000) == 3 and floor.floor(60_000_000) is None


def test_walk_analyses(spark):
    walk_ = spark.createDataFrame([(1, 5, 9), (2, 5, 8), (3, 6, 1), (4, 2, 2), (5, 2, 2)], "pos long, ts long, id long")
    assert stats.order_violations(walk_).first().violations == 2
    assert [r.id for r in stats.duplicates(walk_).collect()] == [2]
    assert stats.amplification(2000, 4, 2) == {"writes_per_1000": 2.0, "transactions_per_1000": 1.0, "rows_per_write": 500.0}


def test_merged_counts_and_unknown_group(messy):
    req = AggregateRequest(BASE, BASE + 60 * times.SECOND, "1m", "nonsense")
    with pytest.raises(ValueError):
        buckets(messy, req)
