"""The token side table: hashes of each row's attributes, for ids below its own watermark, which never passes the pre-aggregate's."""

from __future__ import annotations

import time
import uuid
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import attribute_map, attribute_tokens
from ..model import EDGES, TOKENS, Settings
from ..sources import files
from .manifest import Manifest



def indexed(logs: DataFrame, low: int, high: int) -> DataFrame:
    rows = logs.where((F.col("id") >= F.lit(low)) & (F.col("id") < F.lit(high)))
    return rows.select("id", "ts", attribute_tokens(attribute_map(F.col("attributes"))).alias("tokens"))


def next_batch_rows(now: int, took_ms: float, s: Settings) -> int:
    """Far too slow: back to the least; too slow: three fifths; fast: a quarter more and fifty. Fixed values."""
    if took_ms > 3 * s.index_max_ms:
        return s.index_min_rows
    if took_ms > s.index_max_ms:
        return max(s.index_min_rows, now * 3 // 5)
    if took_ms < s.index_target_ms:
        return min(s.index_max_rows, now * 5 // 4 + 50)
    return now


class TokenTable:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.manifest = Manifest(spark, path, {"watermark_id": 0, "batch_rows": settings.index_min_rows, "parts": [], "rows_indexed": 0, "batches": 0, "last_ms": 0.0, "total_ms": 0.0, "peak_ms": 0.0, "histogram": [0] * (len(EDGES) + 1)})

    def state(self) -> dict:
        return self.manifest.read()[1]

    def read(self, state: dict | None = None) -> DataFrame:
        names = (state or self.state())["parts"]
        if not names:
            return self.spark.createDataFrame([], TOKENS)
        return self.spark.read.schema(TOKENS).parquet(*[f"{self.path}/{n}" for n in names])

    def index(self, logs: DataFrame, limit_id: int, row_cap: int | None = None) -> int:
        """Indexes one batch below limit_id: the rows written, 0 if there is nothing, -1 if another writer was first, -2 if it took too long."""
        number, state = self.manifest.read()
        low = state["watermark_id"]
        high = min(low + min(state["batch_rows"], row_cap or state["batch_rows"]), limit_id)
        if high <= low:
            return 0
        began, name = time.time(), f"tokens-{low:020d}-{high:020d}-{uuid.uuid4().hex[:8]}"
        indexed(logs, low, high).sortWithinPartitions(F.desc("ts"), F.desc("id")).write.parquet(f"{self.path}/{name}")
        rows = self.spark.read.parquet(f"{self.path}/{name}").count()
        took = (time.time() - began) * 1000
        histogram = list(state["histogram"])
        histogram[bisect_right(EDGES, took)] += 1
        try:
            self.manifest.commit(
                number,
                state | {"watermark_id": high, "batch_rows": next_batch_rows(state["batch_rows"], took, self.settings), "parts": state["parts"] + [name], "rows_indexed": state["rows_indexed"] + rows, "batches": state["batches"] + 1, "last_ms": took, "total_ms": state["total_ms"] + took, "peak_ms": max(state["peak_ms"], took), "histogram": histogram},
            )
        except FileExistsError:
            files.delete(self.spark, f"{self.path}/{name}")
            self.manifest.update(lambda now: now | {"contended": now.get("contended", 0) + 1})
            return -1
        return -2 if took > self.settings.index_max_ms else rows

    def run(self, logs: DataFrame, limit_id: int, *, busy: bool = False, folding: bool = False, budget_ms: float = 1000.0) -> int:
        """One cycle: nothing while a fold runs, which is noted as deferred; one least batch when busy; else batches within the budget. Ids indexed."""
        if folding:
            self.manifest.update(lambda now: now | {"deferred": now.get("deferred", 0) + 1})
            return 0
        first = self.state()["watermark_id"]
        began = time.time()
        while self.index(logs, limit_id, self.settings.index_min_rows if busy else None) not in (0, -1) and not busy and (time.time() - began) * 1000 < budget_ms:
            pass
        return self.state()["watermark_id"] - first

    def trim(self, cutoff) -> None:
        """Drops tokens of rows before the cutoff, a column; anew if another writer commits meanwhile."""
        while True:
            number, state = self.manifest.read()
            name = f"tokens-kept-{number + 1:012d}-{uuid.uuid4().hex[:8]}"
            self.read(state).where(F.col("ts") >= cutoff).write.parquet(f"{self.path}/{name}")
            try:
                return self.manifest.commit(number, state | {"parts": [name]})
            except FileExistsError:
                files.delete(self.spark, f"{self.path}/{name}")


def histogram_percentile(histogram: list[int], fraction: float) -> int:
    """The first edge at which the cumulated counts reach the fraction; beyond the last edge, that edge; 0 for none."""
    seen = list(accumulate(histogram))
    if not seen or not seen[-1] * fraction:
        return 0
    return (*EDGES, EDGES[-1])[bisect_left(seen, seen[-1] * fraction)]


def snapshot(state: dict, last_id: int) -> dict:
    """Figures of the index for a status page."""
    n = state["batches"]
    return {"watermark_id": str(state["watermark_id"]), "backlog": max(0, last_id + 1 - state["watermark_id"]), "rows_indexed": state["rows_indexed"], "batches": n, "deferred": state.get("deferred", 0), "contended": state.get("contended", 0), "mean_ms": state["total_ms"] / n if n else 0.0, "peak_ms": state["peak_ms"], "p50_ms": histogram_percentile(state["histogram"], 0.5), "p95_ms": histogram_percentile(state["histogram"], 0.95)}
