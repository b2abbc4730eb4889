"""Where logs come from and where they are kept."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times
from ..model import LOGS, BadRequest
from ..operators.manifest import Manifest
from . import files


def from_events(events: DataFrame) -> DataFrame:
    """The events table as logs: type gives the level, one of eight services by user, a message, props as attributes."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "signup", "info").otherwise("debug").alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("attributes"),
    )


def read_body(text: str) -> list[str]:
    """The entries of a request body {"logs": [...]}, each as JSON text; lone surrogates become U+FFFD."""
    try:
        body = json.loads(text)
    except ValueError as e:
        raise BadRequest("request body must be valid JSON") from e
    if not isinstance(body, dict) or not isinstance(body.get("logs"), list):
        raise BadRequest('request body must be an object with a "logs" array')
    return [json.dumps(x, ensure_ascii=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in body["logs"]]


def entries(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(index, entry) of a batch."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "index int, entry string")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, entry) of files with one JSON entry in a line; the index is unique, and in order within a file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("index"), F.col("value").alias("entry"))


class LogTable:
    """Logs as Parquet, a directory for each ISO week; rows in a file are sorted by service, then id.

    A manifest holds the cutoff: rows before it are in no answer from the moment it is committed,
    whatever is deleted when.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, path, {"cutoff": None})

    def append(self, logs: DataFrame) -> None:
        """Rows of one week go to the same few files: dealt by week and a slice of the id, so that a busy week is no single task's."""
        rows = logs.select(*LOGS.fieldNames()).withColumn("week_start", times.week_start(F.col("ts")))
        dealt = rows.repartition("week_start", F.pmod(F.xxhash64("id"), F.lit(16)))
        dealt.sortWithinPartitions("week_start", "service", "id").write.mode("append").partitionBy("week_start").option("parquet.bloom.filter.enabled#service", "true").parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*LOGS.fields, T.StructField("week_start", T.DateType())])).parquet(self.path)

    def read(self) -> DataFrame:
        """What is stored, from the cutoff on. An empty frame if nothing was ever stored."""
        if not self.weeks():
            return self.spark.createDataFrame([], T.StructType([*LOGS.fields, T.StructField("week_start", T.DateType())]))
        rows, cutoff = self._stored(), self.manifest.read()[1]["cutoff"]
        return rows if cutoff is None else rows.where((F.col("ts") >= times.at(cutoff)) & (F.col("week_start") >= times.week_start(times.at(cutoff))))

    def cut(self, at: int) -> int:
        """Puts the cutoff at this instant, or leaves it if it is later already; the cutoff that holds then."""
        return self.manifest.update(lambda s: s | {"cutoff": max(at, at if s["cutoff"] is None else s["cutoff"])})["cutoff"]

    def withdraw(self, low: int, high: int) -> int:
        """Deletes what an append that failed has left of the ids in [low, high), which its files hold alone; how many files."""
        if not self.weeks():
            return 0
        left = self._stored().where((F.col("id") >= F.lit(low)) & (F.col("id") < F.lit(high))).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        for r in left:
            files.delete(self.spark, r.f)
        return len(left)

    def weeks(self) -> list[str]:
        """The weeks that have a directory."""
        return sorted(n.removeprefix("week_start=") for n in files.children(self.spark, self.path) if n.startswith("week_start="))

    def files(self) -> DataFrame:
        """(week_start, files, rows, least_id, largest_id) of each week that is stored, as a catalog would tell."""
        rows = self._stored().select("week_start", "id", F.col("_metadata.file_path").alias("file"))
        per = rows.groupBy("week_start", "file").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        return per.groupBy("week_start").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("rows"), F.min("lo").alias("least_id"), F.max("hi").alias("largest_id"))


def with_ids(rows: DataFrame, base: int) -> DataFrame:
    """Numbers rows without a gap from base on, in the order of their index, which it replaces.

    The index holds the number of its input partition in its upper bits. Rows are numbered within
    partitions, and the partitions' totals, one row each, are summed up.
    """
    from pyspark.sql.window import Window

    part = F.shiftright("index", 33).alias("part")
    totals = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = rows.withColumn("part", part).withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy("index")))
    return within.join(before, "part").withColumn("id", F.lit(base - 1) + F.col("before") + F.col("within")).drop("index", "part", "before", "within")


def seeded(spark: SparkSession, rows: int, *, days: float = 30, start: str = "2024-01-01", seed: int = 7) -> DataFrame:
    """Generated logs, the same for the same seed: uniform over the days, 8 services, 4 levels, 8 messages, typed attributes."""
    n = F.col("n")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (1 + n % len(xs)).cast("int"))
    micros = F.pmod(F.xxhash64(F.lit(seed), n), F.lit(round(days * 86400 * times.SECOND)))
    base = times.parse_iso(start)
    return spark.range(1, rows + 1).select(F.col("id").alias("n")).select(
        n.alias("id"),
        (times.at(base) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / times.SECOND).cast("decimal(18,6)"))).alias("ts"),
        pick("debug", "info", "warn", "error").alias("level"),
        pick("api", "auth", "billing", "cart", "mail", "search", "stock", "web").alias("service"),
        F.concat(pick("request served", "cache missed", "payment declined", "user signed in", "job queued", "retry planned", "index rebuilt", "mail sent"), F.lit(" #"), n.cast("string")).alias("message"),
        F.to_json(F.named_struct(F.lit("user_id"), (n % 10000).cast("string"), F.lit("region"), pick("north", "south", "east", "west"), F.lit("retries"), n % 5, F.lit("cached"), n % 2 == 0)).alias("attributes"),
    )


def awkward(spark: SparkSession, *, start: str = "2024-05-01", random_rows: int = 1800, collisions: int = 300, reverse: int = 200, late: int = 250) -> DataFrame:
    """Generated logs (id, ts, level, service, message, attributes, part) that make trouble, the same every time.

    Parts, in the order of ids: random within six minutes; the edges of bins; many at one instant;
    falling in time; and late ones, which go into the first minute. Attributes are typed: text,
    whole and broken numbers, truth values.
    """
    base = times.parse_iso(start)
    n = F.col("n")
    edges = (0, 59_999, 60_000, 299_999, 300_000, 3_599_999)  # in milliseconds
    low = [0, random_rows, random_rows + len(edges), random_rows + len(edges) + collisions, random_rows + len(edges) + collisions + reverse]
    part = F.when(n < low[1], "random").when(n < low[2], "edge").when(n < low[3], "collision").when(n < low[4], "reverse").otherwise("late")
    draw = lambda k, most: (n * 1103515245 + 12345 * k) % 2147483647 % most
    micros = (
        F.when(n < low[1], draw(1, 360 * times.SECOND))
        .when(n < low[2], F.get(F.array(*[F.lit(1000 * e) for e in edges]), (n - low[1]).cast("int")).cast("long"))
        .when(n < low[3], F.lit(123 * times.SECOND))
        .when(n < low[4], F.lit(360 * times.SECOND) - (n - low[3]) * 997_000)
        .otherwise(draw(2, 60 * times.SECOND))
    )
    level = F.get(F.array(*map(F.lit, ("debug", "info", "warn", "error"))), draw(3, 4).cast("int"))
    attributes = F.to_json(F.named_struct(F.lit("run"), F.lit("r1"), F.lit("shard"), (n % 7).cast("string"), F.lit("count"), n, F.lit("ratio"), n / 4, F.lit("flag"), n % 2 == 0, F.lit("collision"), F.when(part == "collision", "yes")))
    return spark.range(low[4] + late).select(F.col("id").alias("n")).select(
        (n + 1).alias("id"),
        (times.at(base) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / times.SECOND).cast("decimal(18,6)"))).alias("ts"),
        level.alias("level"),
        F.concat(F.lit("s"), draw(4, 3).cast("string")).alias("service"),
        F.when(n % 3 == 0, F.concat(F.lit("NeedleCase "), n.cast("string"))).otherwise(F.concat(F.lit("ordinary line "), n.cast("string"))).alias("message"),
        attributes.alias("attributes"),
        part.alias("part"),
    )
