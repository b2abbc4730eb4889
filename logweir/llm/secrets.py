"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: any text that
matches must satisfy it. An index holds, for every trigram that some query names, the posting
lists of the documents that contain it, cut into blocks of about BLOCK documents. The queries
are answered by intersecting and joining posting lists; only the candidates are then held
against the expression itself. A rule whose query is "any" scans all texts.

The index is over lower-cased texts, so that a query admits either case; what it admits
wrongly, the expression rejects.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

BLOCK = 4096
#: Up to so many candidates are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if its group has so many characters at least.
    group: int = 0
    least: int = 1


# The three base kinds, then public token formats.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("forge2", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("mapkey", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("mailkey", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("package", r"(npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{16,})"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb][Ee][Aa][Rr][Ee][Rr]\x20+[A-Za-z0-9._~+/-]{16,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!*-]{3,64}@"),
)
BASE = 3

# Boolean trigram queries: ANY, a trigram, or ("and" | "or", parts).
ANY = ("and", ())
#: Sets of strings beyond these sizes are turned into a query and begun anew.
MOST_STRINGS, MOST_CHARS = 12, 24


def _join(op: str, parts) -> tuple | str:
    parts = list(dict.fromkeys(parts))
    if op == "or" and ANY in parts:
        return ANY
    parts = [p for p in parts if p != ANY]
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]) -> tuple | str:
    """What a text satisfies that contains one of the strings."""
    if any(len(s) < 3 for s in strings):
        return ANY
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _letters(items) -> set[str] | None:
    """The lower-cased characters of a class, or None if they are many."""
    out: set[str] = set()
    for op, x in items:
        if op == sre.LITERAL:
            out.add(chr(x).lower())
        elif op == sre.RANGE and x[1] - x[0] < 8:
            out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, tuple | str]:
    """(all strings that the nodes match, if they are few; the query, if not)."""
    now: set[str] = {""}
    found: list = []

    def flush():
        nonlocal now
        found.append(_of_strings(now))
        now = {""}

    for op, x in nodes:
        own: set[str] | None = None
        query: tuple | str = ANY
        if op == sre.LITERAL:
            own = {chr(x).lower()}
        elif op == sre.IN:
            own = _letters(x)
        elif op == sre.SUBPATTERN:
            own, query = _walk(x[-1])
        elif op == sre.BRANCH:
            parts = [_walk(b) for b in x[1]]
            if all(s is not None for s, _ in parts):
                own = set().union(*(s for s, _ in parts))
            else:
                query = _join("or", [q if s is None else _of_strings(s) for s, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = x
            strings, inner = _walk(body)
            if strings is not None and high == 1:
                own = strings | ({""} if low == 0 else set())
            elif low:
                query = inner if strings is None else _of_strings(strings)
        elif op == sre.AT:
            own = {""}
        if own is None or len(now) * len(own) > MOST_STRINGS or max(map(len, now)) + max(map(len, own), default=0) > MOST_CHARS:
            flush()
            if own is None:
                found.append(query)
                continue
        now = {a + b for a in now for b in own}
    if not found:
        return now, _of_strings(now)
    flush()
    return None, _join("and", found)


def trigram_query(pattern: str) -> tuple | str:
    """The query that every text with a match of the pattern satisfies; ANY if there is no trigram that it must have."""
    return _walk(sre.parse(pattern))[1]


def trigrams_of(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]), set())


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str], blocks: int) -> DataFrame:
    """The inverted index: (block, trigram, keys), for the given trigrams (by number) of the lower-cased texts."""
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return (
        low.select("key", F.explode(has).alias("trigram"))
        .groupBy(F.pmod(F.col("key"), F.lit(blocks)).alias("block"), "trigram")
        .agg(F.collect_set("key").alias("keys"))
    )


def answered(index: DataFrame, queries: list, trigrams: list[str]) -> DataFrame:
    """(key, mask): the keys that satisfy a query, with bit i for query i. Each block's lists are intersected alone."""
    number = {t: i for i, t in enumerate(trigrams)}
    lists = index.groupBy("block").agg(*[F.flatten(F.collect_list(F.when(F.col("trigram") == i, F.col("keys")))).alias(f"t{i}") for i in range(len(trigrams))])

    def keys(query) -> Column:
        if isinstance(query, str):
            return F.col(f"t{number[query]}")
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, map(keys, query[1]))

    def rows_of(i: int) -> Column:
        return F.transform(keys(queries[i]), lambda k: F.struct(k.alias("key"), F.lit(1 << i).cast("long").alias("bit")))

    rows = [rows_of(i) for i, q in enumerate(queries) if q != ANY]
    hits = lists.select(F.explode(F.concat(*rows)).alias("hit")).select("hit.*")
    return hits.groupBy("key").agg(F.bit_or("bit").alias("mask"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """The rule's matches in a text as structs, sorted by start. Starts are summed up from the pieces between matches."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = found if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"), F.transform(found, F.char_length).alias("size"), F.transform(sizes, F.char_length).alias("own"))
    empty = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")

    def step(at: Column, x: Column) -> Column:
        start = at["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(at["out"], F.array(span))).otherwise(at["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda at: at["out"])


def scan(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds a column secrets, an array of (start, number of the rule, end, kind), sorted; positions in code points, ends exclusive.

    Null and empty texts have no secrets. Rows that are alike get the same secrets and all stay;
    an empty table stays empty; other columns are carried, whatever their names but "secrets",
    which is replaced. Columns are addressed through one struct, so that none clashes.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    others = [c for c in docs.columns if c not in (text, "secrets")]
    row = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("key"))
    blocks = max(1, -(-docs.count() // block))
    hits = store.written(answered(postings(row, "key", "text", trigrams, blocks), queries, trigrams), "secret-candidates")
    few = store.small(hits, broadcast_rows)
    joined = row.join(F.broadcast(hits) if few else hits, "key", "left")
    full = sum(1 << i for i, q in enumerate(queries) if q == ANY)
    joined = joined.select("row", "text", F.coalesce("mask", F.lit(0)).bitwiseOR(F.lit(full)).alias("mask"))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    whole = F.coalesce("text", F.lit(""))
    parts = []
    for i, rule in enumerate(rules):
        may = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        if queries[i] == ANY:  # one plain test before the spans are taken
            may = whole.rlike(rule.pattern.removesuffix("+") + "{%d}" % rule.least if rule.pattern.endswith("]+") and not rule.group else rule.pattern)
        parts.append(F.when(may, _spans(whole, i, rule)).otherwise(none))
    back = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c != "secrets"]
    return joined.select(*back, F.array_sort(F.concat(*parts)).alias("secrets"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts of the base kinds, a hash of the base spans, all spans."""
    found = scan(docs.select("doc_id", "text"), **options)
    base = F.filter("secrets", lambda s: s["number"] < BASE)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("secrets")).alias("spans"),
    )


def masked(docs: DataFrame, *, text: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every secret replaced by the mask; overlapping secrets give one mask. Texts without secrets stay as they are."""
    columns = docs.columns
    found = scan(docs, text=text, **options)
    t = F.col(f"`{text}`")

    def step(at: Column, s: Column) -> Column:
        fresh = s["start"] >= at["at"]
        out = F.when(fresh, F.concat(at["out"], F.array(F.substring(t, at["at"] + 1, s["start"] - at["at"]), F.lit(mask)))).otherwise(at["out"])
        return F.struct(F.greatest(at["at"], s["end"]).alias("at"), out.alias("out"))

    parts = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda at: F.array_join(F.concat(at["out"], F.array(F.substring(t, at["at"] + 1, F.char_length(t)))), ""))
    clean = F.when(F.size("secrets") > 0, parts).otherwise(t)
    return found.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in columns])


def oracle() -> str:
    """The digest as DuckDB SQL."""
    def kind(i: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        return f"""SELECT rid, {i} AS number, '{r.kind}' AS kind, m, p, regexp_extract_all(text, '{pattern}', {r.group}) AS g FROM
            (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d)"""

    found = " UNION ALL ".join(f"SELECT rid, number, kind, m, p, g, {r.least} AS least FROM ({kind(i, r)})" for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (SELECT rid, number, kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n FROM each WHERE length(g[i]) >= least),
per AS (SELECT rid, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, number) FILTER (number < {BASE}) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, number) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""
