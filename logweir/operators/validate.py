"""Validation of a batch of entries in one pass: each entry is accepted or has the reason of its first fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.strings import sanitized
from ..model import LEVELS, MAX_SERVICE_CHARS
from ..sources.logs import entries, read_body

# Reasons, in the order of the checks.
NOT_OBJECT = "log entry must be a JSON object"
NO_TIME = "timestamp must be a string"
BAD_TIME = "timestamp must be a valid ISO 8601 timestamp"
FUTURE = "timestamp must not be more than five minutes in the future"
BAD_LEVEL = f"level must be one of {', '.join(LEVELS)}"
NO_SERVICE = "service must be a non-empty string"
LONG_SERVICE = f"service must not be longer than {MAX_SERVICE_CHARS} characters"
NO_MESSAGE = "message must be a non-empty string"
BAD_ATTRIBUTES = "attributes must be a JSON object"
BAD_VALUES = "attributes values must be strings, numbers, or booleans"

AHEAD = 5 * 60 * times.SECOND
_ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?$"
_ZONE = r"([Zz]|[+-]\d{2}:?\d{2})$"


def checked(batch: DataFrame, now: int) -> DataFrame:
    """(index, entry) to (index, reason, ts, level, service, message, attributes); now in microseconds.

    A null or broken entry is not an object. Numbers in attributes are brought to one text form:
    whole ones without a fraction.
    """
    v = F.try_parse_json("entry")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get("v", path, "string"))
    row = batch.select("index", v.alias("v")).select(
        "index",
        "v",
        F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("is_object"),
        text("$.timestamp").alias("time"),
        text("$.level").alias("level"),
        sanitized(text("$.service")).alias("service"),
        sanitized(text("$.message")).alias("message"),
        F.coalesce(kind("$.attributes"), F.lit("VOID")).alias("attr_kind"),
        F.try_variant_get("v", "$.attributes", "map<string,variant>").alias("attrs"),
    )
    zoned = F.when(F.col("time").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat("time", F.lit("T00:00:00Z"))).when(F.regexp_like("time", F.lit(r"[Tt ].*" + _ZONE)), F.col("time")).otherwise(F.concat("time", F.lit("Z")))
    micros = F.when(F.col("time").rlike(_ISO), F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.upper(zoned), r"\s+(?=[Z+-])", ""), r"([+-]\d{2})(\d{2})$", "$1:$2"))))
    scalar = lambda x: F.schema_of_variant(x).rlike("^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL)")
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(F.col(c), r"^[\s\p{Z}\x{FEFF}]+$", "")) == "", F.lit(True))
    row = row.withColumn("micros", micros)
    reason = (
        F.when(~F.col("is_object"), NOT_OBJECT)
        .when(F.col("time").isNull(), NO_TIME)
        .when(F.col("micros").isNull(), BAD_TIME)
        .when(F.col("micros") > now + AHEAD, FUTURE)
        .when(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), BAD_LEVEL)
        .when(blank("service"), NO_SERVICE)
        .when(F.char_length("service") > MAX_SERVICE_CHARS, LONG_SERVICE)
        .when(blank("message"), NO_MESSAGE)
        .when(~F.col("attr_kind").startswith("OBJECT") & (F.col("attr_kind") != "VOID"), BAD_ATTRIBUTES)
        .when(F.exists(F.map_values("attrs"), lambda x: ~F.coalesce(scalar(x), F.lit(False))), BAD_VALUES)
    )
    good = F.col("reason").isNull()
    ts = times.at(0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("micros").cast("decimal(20,0)") / F.lit(times.SECOND)).cast("decimal(18,6)"))
    return row.withColumn("reason", reason).select("index", "reason", F.when(good, ts).alias("ts"), *[F.when(good, F.col(c)).alias(c) for c in ("level", "service", "message")], F.when(good, _attributes()).alias("attributes"))


def _attributes() -> Column:
    """The attributes as JSON with sanitised keys and values, each value as it was typed."""

    def plain(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        number = F.try_variant_get(x, "$", "double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        as_text = F.when(kind.startswith("DOUBLE") | kind.startswith("FLOAT") | kind.startswith("DECIMAL"), F.when(whole, number.cast("long").cast("string")).otherwise(F.to_json(x))).when(kind == "STRING", F.to_json(F.parse_json(F.to_json(x)))).otherwise(F.to_json(x))
        return F.replace(as_text, F.lit("\\u0000"), F.lit(""))

    parts = F.transform(F.map_entries(F.coalesce(F.col("attrs"), F.from_json(F.lit("{}"), "map<string,variant>"))), lambda e: F.concat(F.regexp_replace(F.to_json(F.named_struct(F.lit("k"), F.replace(e["key"], F.lit("\0"), F.lit("")))), r'^\{"k":|\}$', ""), F.lit(":"), plain(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("index", "reason")


def oldest_accepted(rows: DataFrame) -> DataFrame:
    return accepted(rows).agg(F.min("ts").alias("oldest"))


def process_body(spark, text: str, now: int) -> tuple[DataFrame, dict, int]:
    """(accepted rows, reply, status) of a request body; all rejected, none included, is a fault of the request."""
    rows = checked(entries(spark, read_body(text)), now)
    bad = sorted(({"index": r["index"], "reason": r["reason"]} for r in rejected(rows).collect()), key=lambda x: x["index"])
    good = accepted(rows)
    n = good.count()
    if not n:
        return good, {"error": "all entries were rejected", "rejected": bad}, 400
    return good, {"accepted": n, "rejected": bad}, 200
