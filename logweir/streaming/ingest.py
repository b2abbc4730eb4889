"""Continuous ingestion, folding, indexing and retention as streams of micro-batches, and the queries that go with them."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import times
from ..model import Settings
from ..operators import page, retention
from ..operators.aggregate import answer
from ..operators.attrindex import TokenTable, snapshot
from ..operators.manifest import Manifest
from ..operators.rollup import NOTHING, RollupTable
from ..operators.validate import accepted, checked
from ..plans.routing import AggregateRequest
from ..sources.logs import LogTable, with_ids
from .admission import CachedState, Gate, IngestFloor, Metrics

DAY = 86400 * times.SECOND


class Engine:
    """The tables of one store, the streams that keep them, and what answers from them.

    The ids manifest holds the next free id and, for each write that has ids and isn't known to be
    whole, its range and clock. Only ids below all of these are folded and indexed, so that a
    slow, half visible or failed write is waited for and never passed by; what it has stored is
    counted from rows meanwhile.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), clock=lambda: time.time_ns() // 1000):
        self.spark, self.path, self.settings, self.clock = spark, path.rstrip("/"), settings, clock
        self.logs = LogTable(spark, f"{path}/logs")
        self.rollup = RollupTable(spark, f"{path}/rollup", settings)
        self.tokens = TokenTable(spark, f"{path}/tokens", settings)
        self.ids = Manifest(spark, f"{path}/ids", {"next": 1, "open": {}, "done": {}})
        self.gate, self.metrics, self.floor = Gate(settings), Metrics(), IngestFloor()
        self.cached = CachedState(self.rollup.source, fallback={})
        self.folding, self.retained = threading.Lock(), None

    # --- writing

    def settled(self) -> int:
        """All rows of smaller ids are stored."""
        state = self.ids.read()[1]
        return min([state["next"], *(w["base"] for w in state["open"].values())])

    def reserve(self, key: str, rows: int, now: int) -> dict:
        """Takes the next ids for a write; a write that has some keeps them, and its clock."""

        def take(state: dict) -> dict | None:
            if key in state["open"]:
                return None
            return state | {"next": state["next"] + rows, "open": state["open"] | {key: {"base": state["next"], "rows": rows, "now": now}}}

        return self.ids.update(take)["open"][key]

    def finish(self, key: str, stream: str | None = None, batch_id: int = 0) -> None:
        """Says that a write is whole, or given up: what it stored counts from now on, and its other ids stay unused."""

        def done(state: dict) -> dict:
            state["open"].pop(key, None)
            if stream is not None:
                state["done"][stream] = max(batch_id, state["done"].get(stream, batch_id))
            return state

        self.ids.update(done)

    def write_batch(self, batch: DataFrame, batch_id: int, stream: str = "ingest") -> None:
        """Validates a batch of (entry) and appends what is accepted, with ids above all earlier ones. The batch ids of a stream rise.

        Ids are reserved before the rows are written. A batch that comes again after a failure is
        validated by the clock of its first try and takes the ids that were reserved for it; what
        that try has left is withdrawn first, so that rows are stored once. A batch that is whole
        is left alone.
        """
        state = self.ids.read()[1]
        if batch_id <= state["done"].get(stream, -1):
            return
        key = f"{stream}-{batch_id}"
        again = state["open"].get(key)
        now = again["now"] if again else self.clock()
        if "index" not in batch.columns:
            batch = batch.withColumn("index", F.monotonically_increasing_id())
        rows = accepted(checked(batch.select("index", "entry"), now)).persist()
        try:
            with self.metrics.timed("ingest") as trace:
                n, oldest = rows.agg(F.count("*"), F.min("ts")).first()
                trace["rows"] = n
                if n:
                    if again and again["rows"] != n:
                        raise ValueError(f"batch {key} had {again['rows']} rows when it came first, and has {n} now")
                    write = self.reserve(key, n, now)
                    if again:
                        self.logs.withdraw(write["base"], write["base"] + n)
                    with self.metrics.stage(trace, "write"):
                        self.logs.append(with_ids(rows, write["base"]))
                    self.floor.note(times.to_micros(oldest), now)
                self.finish(key, stream, batch_id)
        finally:
            rows.unpersist()

    def adopt(self, logs: DataFrame, key: str = "adopted") -> None:
        """Stores rows that have ids already, which must not be below what is settled. Later writes take ids above them."""
        low, high = logs.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return
        if low < self.rollup.state()["watermark_id"]:
            raise ValueError("ids below the watermark would never be folded")
        self.ids.update(lambda s: s | {"next": max(s["next"], high + 1), "open": s["open"] | {key: {"base": low, "rows": high + 1 - low, "now": self.clock()}}})
        self.logs.append(logs)
        self.finish(key)

    def ingest(self, source: str, *, continuous: bool = False, stream: str = "ingest", files_at_once: int = 1000) -> StreamingQuery:
        """Follows a folder of files with one JSON entry in a line; a write holds so many files at most. Streams of one store have names of their own."""
        lines = self.spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(source).select(F.col("value").alias("entry"))
        out = lines.writeStream.foreachBatch(lambda batch, i: self.write_batch(batch, i, stream)).option("checkpointLocation", f"{self.path}/_checkpoints/{stream}")
        return (out.trigger(processingTime="1 second") if continuous else out.trigger(availableNow=True)).start()

    # --- upkeep

    def fold(self) -> None:
        """Folds all settled ids that are waiting."""
        with self.folding:
            below = self.settled()  # before the files are listed, so that all of these are seen
            logs = self.logs.read()
            while self.rollup.fold(logs, now=self.clock(), first_id=1, below=below) != NOTHING and self.rollup.state()["behind"]:
                pass

    def index(self) -> int:
        """One cycle of the indexer, up to the pre-aggregate's watermark; deferred while a fold runs."""
        limit = self.rollup.state()["watermark_id"]
        return self.tokens.run(self.logs.read(), limit, busy=self.gate.busy(), folding=self.folding.locked())

    def retain(self) -> dict:
        """Applies the retention of the settings."""
        self.retained = self.clock()
        return retention.enforce(self.logs, retention.cutoff(self.retained, self.settings.retention_days), self.rollup, self.tokens)

    def maintain(self, _batch: DataFrame | None = None, _batch_id: int = 0) -> None:
        """Folds, then indexes, and once a day applies the retention."""
        self.fold()
        self.index()
        if self.retained is None or self.clock() - self.retained >= DAY:
            self.retain()

    def _following(self, what, name: str, seconds: int, continuous: bool) -> StreamingQuery:
        rows = self.spark.readStream.schema(self.logs.read().schema).parquet(self.logs.path)
        out = rows.writeStream.foreachBatch(what).option("checkpointLocation", f"{self.path}/_checkpoints/{name}")
        return (out.trigger(processingTime=f"{seconds} seconds") if continuous else out.trigger(availableNow=True)).start()

    def follow(self, *, continuous: bool = False) -> StreamingQuery:
        """Maintains the derived tables whenever rows were stored. The fold goes by ids, not by event time: no row is ever too late."""
        return self._following(self.maintain, "follow", self.settings.fold_seconds, continuous)

    def follow_index(self, *, continuous: bool = True) -> StreamingQuery:
        """Indexes on a trigger of its own, beside folds."""
        return self._following(lambda _batch, _i: self.index() and None, "index", self.settings.index_seconds, continuous)

    def drain(self, *queries: StreamingQuery) -> None:
        """Waits until all that has come is stored, and stops the streams."""
        for q in queries:
            if q.isActive:
                q.processAllAvailable()
                q.stop()

    # --- answering

    def count(self, params: dict) -> tuple[list[dict], str]:
        """The buckets of an aggregate request, and the path that answered. One lane for what the pre-aggregate bounds, one for scans; if its state can't be read, rows answer."""
        req = AggregateRequest.parse(params)
        with self.metrics.timed("count", cost=req.cost) as trace:
            with self.gate.admitted(req.cost) as waited:
                trace["wait_ms"] = waited
                with self.metrics.stage(trace, "state"):
                    source = self.cached.get()
                with self.metrics.stage(trace, "run"):
                    buckets, trace["path"] = answer(self.logs.read(), req, **source)
        return buckets, trace["path"]

    def page(self, params: dict) -> tuple[list[dict], str | None]:
        """A page of a page request, and the next one's cursor. Pages that search texts run one at a time."""
        req = page.PageRequest.parse(params)
        with self.metrics.timed("page") as trace:
            if req.q is None:
                return self._page(req, trace)
            with self.gate.admitted("marker") as trace["wait_ms"]:
                return self._page(req, trace)

    def _page(self, req: page.PageRequest, trace: dict) -> tuple[list[dict], str | None]:
        with self.metrics.stage(trace, "state"):
            state = self.tokens.state() if req.attributes else {"watermark_id": 0}
        with self.metrics.stage(trace, "run"):
            tokens = self.tokens.read(state) if state["watermark_id"] else None
            found = page.query(self.logs.read(), req, tokens, state["watermark_id"])
        trace["rows"] = len(found[0])
        return found

    def stats(self) -> dict:
        """State of the derived tables against the stored rows, and the figures of what ran."""
        rollup = self.rollup.state()
        last = self.logs.read().agg(F.max("id")).first()[0]
        now = self.clock()
        safe = rollup["safe_before"]
        return {
            "rollup": {k: rollup[k] for k in ("watermark_id", "width", "refreshes", "behind", "last_rows", "last_ms")} | {"hot_tail_seconds": None if safe is None else (now - safe) / 1e6, "deltas": len(rollup["deltas"]), "settled": self.settled()},
            "index": snapshot(self.tokens.state(), last if last is not None else -1),
            "ingest": {"open_writes": len(self.ids.read()[1]["open"]), "floor": self.floor.floor(now)},
            "metrics": self.metrics.snapshot(),
            "decomposition": self.metrics.decomposition(),
        }
