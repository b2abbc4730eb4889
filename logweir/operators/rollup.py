"""The pre-aggregate: counts by 10-second bin, service and level, folded by ranges of ids.

A fold counts the rows of [from, to) into a delta of its own and then commits the watermark
"to". Rows at or above the watermark are never in the pre-aggregate, those below always, however
late their timestamps are. A fold that dies leaves a delta that no manifest names. Ids are
reserved before their rows are stored: who folds beside writers must say below which id all rows
are there, or rows of an unfinished write would be passed by for good.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..model import DELTA, Settings
from ..sources import files
from .manifest import Manifest

#: What a fold says that found no new ids.
NOTHING = "nothing to fold"


def folded(logs: DataFrame, low: int, high: int, width: int = 10) -> DataFrame:
    """The delta of the ids in [low, high)."""
    rows = logs.where((F.col("id") >= F.lit(low)) & (F.col("id") < F.lit(high)))
    keyed = rows.select(times.time_bin(F.col("ts"), width).alias("bucket_start"), "service", "level")
    return keyed.groupBy("bucket_start", "service", "level").agg(F.count("*").alias("entry_count"))


class RollupTable:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.manifest = Manifest(spark, path, {"watermark_id": 0, "width": settings.rollup_width, "deltas": [], "safe_before": None, "refreshes": 0, "skipped": 0, "behind": False, "last_rows": 0, "last_ms": 0.0})

    def state(self) -> dict:
        return self.manifest.read()[1]

    def read(self, state: dict | None = None) -> DataFrame:
        """The deltas that the state names, and only those: a reader that keeps its state keeps its snapshot. A bin whose rows came in several folds has a row in each of them."""
        names = (state or self.state())["deltas"]
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{n}" for n in names])

    def totals(self, state: dict | None = None) -> DataFrame:
        """What read() gives, summed up: one row for each bin, service and level, however many folds its rows came in."""
        return self.read(state).groupBy("bucket_start", "service", "level").agg(F.sum("entry_count").cast("long").alias("entry_count"))

    def source(self) -> dict:
        """What counts() takes, of one snapshot."""
        state = self.state()
        return {"rollup": self.read(state), "watermark": state["watermark_id"], "stored": state["width"]}

    def fold(self, logs: DataFrame, *, now: int | None = None, first_id: int = 0, below: int | None = None) -> str:
        """Folds what is new, at most max_fold_rows ids, and commits; a summary of what was done.

        below: all rows of smaller ids are stored, and in logs. Without it the largest id in logs
        bounds the fold, which is right only if nobody is writing. Of two folds of one range, one
        commits and the other fails.
        """
        number, state = self.manifest.read()
        began = time.time()
        low = max(state["watermark_id"], first_id)
        if below is None:
            last = logs.agg(F.max("id")).first()[0]
            below = 0 if last is None else last + 1
        high = min(below, low + self.settings.max_fold_rows)
        if high <= low:
            return NOTHING
        name = f"delta-{low:020d}-{high:020d}-{uuid.uuid4().hex[:8]}"
        folded(logs, low, high, state["width"]).write.parquet(f"{self.path}/{name}")
        rows = self.spark.read.schema(DELTA).parquet(f"{self.path}/{name}").agg(F.coalesce(F.sum("entry_count"), F.lit(0))).first()[0]
        behind = high < below
        if not behind and now is not None:
            safe = times.floor_to(now - self.settings.rollup_lag_seconds * times.SECOND, state["width"])
            state["safe_before"] = max(state["safe_before"] or safe, safe)
        state |= {"watermark_id": high, "deltas": state["deltas"] + [name], "refreshes": state["refreshes"] + 1, "behind": behind, "last_rows": rows, "last_ms": (time.time() - began) * 1000}
        self.manifest.commit(number, state)
        if len(state["deltas"]) > self.settings.compact_deltas:
            self.compact()
        return f"folded {rows} rows of ids {low} to {high - 1}" + (", more are waiting" if behind else "")

    def compact(self) -> None:
        """Sums all deltas into one; the old ones stay until purge()."""
        self.replace(self.totals)

    def rebuild(self, width: int) -> None:
        """Begins anew at another width."""
        Settings(rollup_width=width)
        number, state = self.manifest.read()
        self.manifest.commit(number, state | {"width": width, "watermark_id": 0, "deltas": [], "safe_before": None})

    def replace(self, rows: Callable[[dict], DataFrame]) -> None:
        """Puts rows(state) in the place of all deltas; the watermark stays. If another writer commits meanwhile, it is done anew on that state."""
        while True:
            number, state = self.manifest.read()
            name = f"delta-kept-{number + 1:012d}-{uuid.uuid4().hex[:8]}"
            rows(state).write.parquet(f"{self.path}/{name}")
            try:
                return self.manifest.commit(number, state | {"deltas": [name]})
            except FileExistsError:
                files.delete(self.spark, f"{self.path}/{name}")

    def purge(self) -> int:
        """Deletes deltas that the last manifest doesn't name. Readers of older snapshots must be done."""
        keep = set(self.state()["deltas"])
        gone = [n for n in files.children(self.spark, self.path) if n.startswith("delta-") and n not in keep]
        for n in gone:
            files.delete(self.spark, f"{self.path}/{n}")
        return len(gone)


def bounds(rollup: DataFrame) -> DataFrame:
    """One row: the oldest and newest bucket."""
    return rollup.agg(F.min("bucket_start").alias("oldest"), F.max("bucket_start").alias("newest"))
