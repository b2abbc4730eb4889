"""Benchmark decontamination: a prefix-filtered join of word windows.

A window is WINDOW consecutive words of an item (all its words, if it has fewer). Its tokens are
its word shingles. A document that contains the window contains all of its tokens, so that for
containment in full the prefix, in the order of rarity in the whole corpus, is its rarest token
alone. Windows of which a token occurs nowhere are dropped. The documents' shingles are joined
with the prefix tokens; a pair must then fit by position and length (the window may not begin
before the text or end after it), and at last word by word.

The shingles of the documents never leave their task: what isn't a prefix token by a bitmap of
fixed size is dropped in the row, and what is left is joined with the table of windows, which is
broadcast if it is small, or by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .text import GAP, UPPER, words

WINDOW, SHINGLE = 10, 3
#: Windows up to this number are broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000
#: Bits of the bitmap of prefix tokens; more windows only let more candidates through to the join.
BITS = 1 << 18


def _shingles(ws: Column, size: int) -> Column:
    """Hashes of all shingles of so many words; those at the end have fewer words, and equal no full one."""
    return F.transform(ws, lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(ws, i + n) for n in range(1, size)]))


def windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows and the sorted ids, as strings, of the items that have them."""
    ws = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    cut = F.when(F.size("ws") <= window, F.array("ws")).otherwise(F.transform(F.sequence(F.lit(1), F.size("ws") - window + 1), lambda i: F.slice("ws", i, window)))
    return ws.select("item", F.explode(cut).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def _prefixes(wins: DataFrame, docs_words: DataFrame, shingle: int, few: bool) -> DataFrame:
    """Adds to each window its rarest token (hash), the token's offset and size. Counts are over all documents."""
    size = F.least(F.size("window"), F.lit(shingle))
    by_size = [r.size for r in wins.select(size.alias("size")).distinct().collect()]  # at most as many as shingle
    tokens = wins.select("window", "items", size.alias("size"))
    full = lambda n: F.slice(_shingles(F.col("window"), n), F.lit(1), F.size("window") - n + 1)
    each = F.coalesce(*[F.when(F.col("size") == n, full(n)) for n in by_size]) if by_size else F.array().cast("array<bigint>")
    tokens = tokens.select("window", "items", "size", F.posexplode(each).alias("offset", "hash"))
    known = tokens.select("hash").distinct()
    seen = docs_words.select(F.explode(F.concat(*[_shingles(F.col("ws"), n) for n in by_size])).alias("hash")) if by_size else known
    counts = seen.join(F.broadcast(known) if few else known, "hash", "left_semi").groupBy("hash").count()
    ranked = tokens.join(counts, "hash", "left").groupBy("window").agg(
        F.first("items").alias("items"),
        F.min(F.coalesce("count", F.lit(0))).alias("least"),
        F.min(F.struct(F.coalesce("count", F.lit(0)), "hash", "offset", "size")).alias("t"),
    )
    return ranked.where("least > 0").select("window", "items", "t.hash", "t.offset", "t.size")


def _bitmap(prefixes: DataFrame, bits: int) -> Column:
    """The prefix tokens as an array of longs, of fixed size."""
    slots = prefixes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).cast("int").alias("slot")).distinct().collect()
    longs = [0] * (bits // 64)
    for (s,) in slots:
        longs[s >> 6] |= 1 << (s & 63)
    return F.from_json(F.lit("[" + ",".join(str(x - (1 << 64) if x >> 63 else x) for x in longs) + "]"), "array<bigint>")


def hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds to each document n_words, n_hit (words inside an occurrence of a window) and item_ids (strings, sorted).

    Null and empty texts have no words and no hits; items without words have no windows; items
    without an id count for n_hit, but aren't listed. Rows that are alike all stay. Columns of the
    documents with these names are replaced, others are carried.
    """
    out = ("n_words", "n_hit", "item_ids")
    others = [c for c in docs.columns if c not in (text, *out)]
    wins = store.written(windows(items, item_id, item_text, window), "windows")
    few = store.small(wins, broadcast_rows)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("text"))
    split = rows.select("row", F.xxhash64("text").alias("hash_of_text"), words(F.col("text")).alias("ws"))
    table = store.written(_prefixes(wins, rows.select(words(F.col("text")).alias("ws")), shingle, few), "prefix-tokens")
    bits = _bitmap(table, BITS)
    sizes = [r.size for r in table.select("size").distinct().collect()]  # at most as many as shingle

    def candidates(n: int) -> Column:
        def one(h: Column, i: Column) -> Column:
            bit = F.getbit(F.get(bits, F.shiftright(h.bitwiseAND(F.lit(BITS - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int"))
            first = F.greatest(i - (window - 1), F.lit(0))
            return F.when(bit == 1, F.struct(h.alias("hash"), i.alias("at"), first.alias("first"), F.slice("ws", first + 1, 2 * window - 1).alias("near")))

        return F.array_compact(F.transform(f"h{n}", one))

    head = F.array(F.lit(None).cast("struct<hash:bigint,at:int,first:int,near:array<string>>"))
    hashed = split.select("row", "hash_of_text", "ws", *[_shingles(F.col("ws"), n).alias(f"h{n}") for n in sizes])
    each = hashed.select("row", "hash_of_text", F.size("ws").cast("long").alias("n_words"), F.explode(F.concat(head, *[candidates(n) for n in sizes])).alias("c"))
    each = each.select("row", "hash_of_text", "n_words", F.col("c.hash").alias("hash"), "c.at", "c.first", "c.near")
    pairs = each.join(F.broadcast(table) if few else table, "hash", "left")
    begin, length = F.col("at") - F.col("offset"), F.size("window")
    fits = (begin >= F.col("first")) & (begin + length <= F.col("n_words")) & (F.slice("near", F.greatest(begin - F.col("first"), F.lit(0)) + 1, length) == F.col("window"))
    found = pairs.where(F.col("hash").isNull() | fits).select("row", "hash_of_text", "n_words", F.col("hash").isNull().cast("long").alias("head"), F.when(F.col("hash").isNotNull(), F.struct(begin.alias("begin"), (begin + length).alias("end"))).alias("span"), "items")
    by_row = found.groupBy("row", "hash_of_text").agg(F.max("n_words").alias("n_words"), F.sum("head").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(s["begin"], a["end"]), F.lit(0))).alias("n")), lambda a: a["n"])
    result = by_row.select("row", "n_words", n_hit.alias("n_hit"), "item_ids", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return result.select(*[F.col(f"row.`{c}`") for c in others], *out)


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: its words, how many are hit, by how many items, and a hash of their ids."""
    found = hits(docs.select("doc_id", "text"), items.select("item_id", "text"), **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: float = 0.0, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The documents of which at most this share of words is hit; all columns and copies stay. A row is known by its id and text.

    Null and empty texts have no words and stay; null ids are ids like others; without items, or
    on an empty table, everything stays.
    """
    own = F.xxhash64(F.col(f"`{text}`"))
    with store.passing():
        found = hits(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), own.alias("own")), items, broadcast_rows=broadcast_rows, **options)
        bad = found.where(F.col("n_hit") > most * F.col("n_words")).select(F.col("id").alias("_bad_id"), F.col("own").alias("_bad_text")).distinct()
        bad = store.kept(store.written(bad, "leaks"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_bad_id")) & (own == F.col("_bad_text"))
    return docs.join(F.broadcast(bad) if store.small(bad, broadcast_rows) else bad, same, "left_anti")


def oracle() -> str:
    """The digest as DuckDB SQL, by comparing windows outright."""
    ws = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{GAP}'), lambda x: x <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {ws} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ws} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1), lambda i: ws[i:i + {WINDOW} - 1])) AS win FROM b WHERE len(ws) > 0),
starts AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
hit AS (SELECT rid, i, n, item FROM (SELECT rid, i, n, ws[i:i + n - 1] AS win FROM starts) JOIN w USING (n, win)),
covered AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS j FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN ids USING (rid)"""
