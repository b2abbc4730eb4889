"""License scans by ordered signature rules.

Texts are brought to lower-cased words first (see text.words), each word between two spaces of
its own, so that one rule's matches may stand side by side. Rules are identifiers, statements that
something is under a license, passages of licenses and of the notices that they ask for, and names
that only occur. From each rule's expression the pieces of text are derived that every match must
hold; a text is held against rules only if it has such a piece of some rule, and against a rule
only if it has the rule's longest piece and its keyword. Every match is a detection, an interval with
the rule's tier and label. A detection is suppressed if another of the same or a better tier
contains it; of two with the same interval the rule that comes first stays. What is left gives the
labels.
"""

from __future__ import annotations

import json
import re._parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import GAP, UPPER, words

# Phrases of the base, as (words before "license", label).
BASE = ((("mit",), "mit"), (("apache",), "apache"), (("general", "public"), "gpl"))

# Licenses as (label, keyword, expression for the name). A space stands between two words.
NAMES = (
    ("mit", "mit", "(?:the )?mit(?: expat| x11)? licen[cs]e"),
    ("mit-0", "attribution", "mit no attribution(?: licen[cs]e)?"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: v| version)? 2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version)? 1 1"),
    ("apache-1.0", "apache", "apache(?: software)? licen[cs]e(?: version)? 1 0"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("gpl-1.0", "general", "(?:gnu )?general public licen[cs]e(?: v| version)? 1(?: 0)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public licen[cs]e(?: v| version)? 2(?: 0)?"),
    ("gpl-3.0", "general", "(?:gnu )?general public licen[cs]e(?: v| version)? 3(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: ?v| version)? ?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: ?v| version)? ?3(?: 0)?"),
    ("gpl", "general", "(?:gnu )?general public licen[cs]e"),
    ("gpl", "gpl", "gnu gpl"),
    ("lgpl-2.0", "library", "(?:gnu )?library general public licen[cs]e(?: v| version)? 2(?: 0)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: v| version)? 2 1"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: v| version)? 3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: ?v| version)? ?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: ?v| version)? ?3(?: 0)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"),
    ("agpl-1.0", "affero", "affero general public licen[cs]e(?: v| version)? 1(?: 0)?"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?: v| version)? 3(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: ?v| version)? ?3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("gfdl-1.2", "documentation", "(?:gnu )?free documentation licen[cs]e(?: v| version)? 1 2"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation licen[cs]e(?: v| version)? 1 3"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[cs]e"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[cs]e"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: v| version)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: v| version)? 2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: v| version)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: v| version)? 2(?: 0)?"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[cs]e(?: v| version)? 1(?: 0)?"),
    ("eupl-1.1", "union", "european union public licen[cs]e(?: v| version)? 1 1"),
    ("eupl-1.2", "union", "european union public licen[cs]e(?: v| version)? 1 2"),
    ("cddl-1.0", "development", "common development and distribution licen[cs]e(?: v| version)?(?: 1 0)?"),
    ("cpl-1.0", "common", "common public licen[cs]e(?: v| version)?(?: 1 0)?"),
    ("artistic-1.0", "artistic", "artistic licen[cs]e(?: version)? 1 0"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version)? 2 0"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("bsl-1.0", "boost", "boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business", "business source licen[cs]e(?: version)?(?: 1 1)?"),
    ("sspl-1.0", "server", "server side public licen[cs]e(?: v| version)?(?: 1)?"),
    ("elastic-2.0", "elastic", "elastic licen[cs]e(?: v| version)?(?: ?2 0)?"),
    ("isc", "isc", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", "libpng licen[cs]e"),
    ("unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("python-2.0", "python", "python(?: software foundation)? licen[cs]e"),
    ("php-3.01", "php", "php licen[cs]e(?: version)?(?: 3 01)?"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("ofl-1.1", "font", "(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "database", "open database licen[cs]e(?: v| version)?(?: 1 0)?"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e"),
    ("pddl-1.0", "domain", "public domain dedication and licen[cs]e"),
    ("upl-1.0", "universal", "universal permissive licen[cs]e"),
    ("ecl-2.0", "educational", "educational community licen[cs]e"),
    ("afl-3.0", "academic", "academic free licen[cs]e"),
    ("osl-3.0", "open", "open software licen[cs]e"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("cecill-2.1", "cecill", "cecill(?: free software)? licen[cs]e"),
    ("mulan-2.0", "mulan", "mulan(?: permissive software)? licen[cs]e"),
    ("nasa-1.3", "nasa", "nasa open source agreement"),
    ("vim", "vim", "vim licen[cs]e"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?"),
    ("public-domain", "domain", "(?:in|into|to) the public domain"),
    ("all-rights-reserved", "rights", "all rights reserved"),
)
# Short names that count only after a statement such as "licensed under", as (label, keyword, expression).
SHORT = (
    ("mit", "mit", "mit"),
    ("apache-2.0", "apache", "apache 2(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd)"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("mpl-2.0", "mpl", "mpl(?: v| version)? ?2(?: 0)?"),
    ("epl-2.0", "epl", "epl(?: v| version)? ?2(?: 0)?"),
    ("eupl-1.2", "eupl", "eupl(?: v| version)? ?1 2"),
    ("gpl", "gpl", "gpl"),
    ("lgpl", "lgpl", "lgpl"),
    ("agpl", "agpl", "agpl"),
)
# Passages of licenses and notices, as (label, keyword, expression).
PASSAGES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "endorse", "neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "distributed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "subject", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("cddl-1.0", "subject", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights to"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2.0", "artistic", "you may redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("postgresql", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prohibited", "unauthorized (?:copying|use|reproduction)(?: or distribution)? of this (?:file|software|document) via any medium is strictly prohibited"),
)
# Parts of Creative Commons names, as (label, words).
COMMONS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv[a-z]+"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv[a-z]+"))
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

Rule = tuple[int, str, str, str]  # tier, label, keyword, expression


def rules() -> tuple[Rule, ...]:
    """Tier 1: identifiers; 2: statements that something is under a license, and passages; 3: names that only occur."""
    names = list(NAMES)
    for part, long in COMMONS:
        short = part.replace("-", " ")
        for v in VERSIONS:
            names.append((f"cc-{part}-{v.replace(' ', '.')}", " cc ", f"cc {short} {v}"))
            names.append((f"cc-{part}-{v.replace(' ', '.')}", "commons", f"creative commons {long}(?: licen[cs]e)?(?: version)? {v}(?: international| unported| generic)?"))
        names.append((f"cc-{part}", " cc ", f"cc {short}"))
        names.append((f"cc-{part}", "commons", f"creative commons {long}(?: licen[cs]e)?"))
    labels = sorted({x[0] for x in names})
    found: list[Rule] = [(1, x, "spdx", f"spdx licen[cs]e identifier {x.replace('-', ' ').replace('.', ' ')}(?: only| or later)?") for x in labels]
    under = "(?:licen[cs]ed|released|distributed|available|published|provided|redistribute it)(?: and or modify it)? (?:under|with)(?: the)?(?: terms of)?(?: the)?(?: following)?"
    found += [(2, x, key, e) for x, key, e in PASSAGES]
    found += [(2, x, key, f"{under} {name}(?: only| or later| or any later version)?") for x, key, name in names]
    found += [(2, x, key, f"{under.replace('(?:under|with)', 'under')} {name}(?: only| or later| or any later version)?") for x, key, name in SHORT]
    found += [(3, x, key, name) for x, key, name in names]
    return tuple((t, x, key, " " + e.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " ") for t, x, key, e in found)


def pieces(expression: str) -> list[str]:
    """The pieces of text that every match of the expression holds, in their order."""
    runs, now = [], ""
    for op, x in sre.parse(expression):
        if op == sre.LITERAL:
            now += chr(x)
        else:
            runs.append(now)
            now = ""
    return [r for r in (*runs, now) if r.strip()]


def piece(key: str, expression: str) -> str:
    """The longest piece of a rule, or its keyword if that is longer."""
    return max([key, *pieces(expression)], key=lambda p: len(p.strip()))


def gates(found: tuple[Rule, ...]) -> list[str]:
    """Pieces of text of which every text has one that any rule matches: the stem of "license" for rules that hold it, else the rule's own; none that contains another."""
    every = {"licen" if any("licen" in p for p in pieces(e)) else piece(k, e) for _, _, k, e in found}
    return [p for p in sorted(every) if not any(k != p and k in p for k in every)]


#: Confidence by tier.
SCORES = (1.0, 0.9, 0.6)
_KEPT = "struct<start:int,below:int,number:int,tier:int,label:string>"


def _table(found: tuple[Rule, ...]) -> Column:
    """The rules as an array of structs; one literal for the planner, however many they are."""
    rows = [{"number": i, "tier": t, "label": x, "key": k, "piece": piece(k, e), "rx": e} for i, (t, x, k, e) in enumerate(found)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<number:int,tier:int,label:string,key:string,piece:string,rx:string>>")


def _matches(s: Column, rule: Column) -> Column:
    """The detections of one rule in a text, as structs that sort by start, then the longest, then the rule's number."""
    steps = F.arrays_zip(F.transform(F.split(s, rule["rx"], -1), F.char_length).alias("gap"), F.transform(F.regexp_extract_all(s, rule["rx"], F.lit(0)), F.char_length).alias("size"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.struct(start.alias("start"), (-end).alias("below"), rule["number"].alias("number"), rule["tier"].alias("tier"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.when(x["size"].isNotNull(), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_KEPT}>").alias("out")), step, lambda a: a["out"])


def _kept(found: Column) -> Column:
    """Labels and best tier of the sorted detections that no earlier one of their tier or a better one contains."""
    start = F.struct(*[F.lit(0).alias(f"m{t}") for t in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"))

    def step(a: Column, d: Column) -> Column:
        end = -d["below"]
        most = F.greatest(a["m1"], F.when(d["tier"] >= 2, a["m2"]).otherwise(0), F.when(d["tier"] >= 3, a["m3"]).otherwise(0))
        stays = most < end
        return F.struct(
            *[F.when(d["tier"] == t, F.greatest(a[f"m{t}"], end)).otherwise(a[f"m{t}"]).alias(f"m{t}") for t in (1, 2, 3)],
            F.when(stays & ~F.array_contains(a["labels"], d["label"]), F.concat(a["labels"], F.array(d["label"]))).otherwise(a["labels"]).alias("labels"),
            F.when(stays, F.least(a["best"], d["tier"])).otherwise(a["best"]).alias("best"),
        )

    return F.aggregate(found, start, step, lambda a: F.struct(a["labels"].alias("labels"), a["best"].alias("best")))


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Null and empty texts have no words and no labels, and score 0. Rows that are alike all stay;
    columns with these names are replaced, others are carried.
    """
    out = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    others = [c for c in docs.columns if c not in out]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), words(F.col(f"`{text}`")).alias("ws"))
    gate = rows.select("row", F.size("ws").cast("long").alias("n_words"), F.when(F.exists("ws", lambda w: w == "license"), F.col("ws")).alias("ws"), F.concat(F.lit(" "), F.array_join("ws", "  "), F.lit(" ")).alias("s"))
    some = F.exists(F.from_json(F.lit(json.dumps(gates(rules()))), "array<string>"), lambda g: F.contains("s", g))
    gate = gate.select("row", "n_words", "ws", F.when(some, F.col("s")).alias("s"))
    at = F.array_compact(F.transform("ws", lambda w, i: F.when(w == "license", i)))
    before = lambda i, n: F.get("ws", i - n)

    def place(i: Column) -> Column:
        found = F.lit(None).cast("struct<start:bigint,label:string>")
        for phrase, label in reversed(BASE):
            same = F.lit(True)
            for n, w in enumerate(reversed(phrase), 1):
                same = same & (before(i, n) == w)
            found = F.when(same, F.struct((i - len(phrase)).cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(found)
        return found

    places = F.coalesce(F.array_compact(F.transform(at, place)), F.array().cast("array<struct<start:bigint,label:string>>"))
    found = F.flatten(F.transform(F.filter(_table(rules()), lambda r: F.contains("s", r["piece"]) & F.contains("s", r["key"])), lambda r: _matches(F.col("s"), r)))
    step = gate.select("row", "n_words", places.alias("places"), F.when(F.col("s").isNotNull(), _kept(F.array_sort(found))).alias("kept"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_union(base, F.coalesce("kept.labels", F.array().cast("array<string>"))))
    score = F.coalesce(F.get(F.array(*map(F.lit, SCORES)), F.col("kept.best") - 1), F.when(F.size("places") > 0, F.lit(SCORES[2])).otherwise(F.lit(0.0)))
    return step.select(
        *[F.col(f"row.`{c}`") for c in others],
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, as scan() has it; null ids and rows that are alike all stay, an empty table gives an empty one."""
    return scan(docs.select("doc_id", "text")).drop("text")


def oracle() -> str:
    """The digest as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {t}, {quote(x)}, {quote(k)}, {quote(e)})" for i, (t, x, k, e) in enumerate(rules()))
    ws = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{GAP}'), lambda x: x <> '')"
    phrases = " UNION ALL ".join(f"SELECT rid, i - {len(p) + 1} AS start, '{x}' AS label FROM lic WHERE " + " AND ".join(f"i > {n} AND ws[i - {n}] = '{w}'" for n, w in enumerate(reversed(p), 1)) for p, x in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {ws} AS ws FROM documents),
lic AS (SELECT rid, ws, i FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE list_contains(ws, 'license')) WHERE ws[i] = 'license'),
base AS ({phrases}),
b AS (SELECT rid, count(*) AS n, min(start) AS lo, max(start) AS hi, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY rid),
rules(number, tier, label, key, rx) AS (VALUES {values}),
g AS MATERIALIZED (SELECT rid, ' ' || array_to_string(ws, '  ') || ' ' AS s FROM d),
m AS MATERIALIZED (SELECT rid, number, tier, label, regexp_extract_all(s, rx) AS m, regexp_split_to_array(s, rx) AS p FROM g JOIN rules ON contains(s, key)),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
x AS MATERIALIZED (SELECT rid, number, tier, label, list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS a, length(m[i]) AS n FROM e),
k AS (SELECT rid, tier, label FROM x WHERE NOT EXISTS (SELECT 1 FROM x AS y WHERE y.rid = x.rid AND y.tier <= x.tier AND y.a <= x.a AND y.a + y.n >= x.a + x.n AND (y.a < x.a OR y.n > x.n OR y.number < x.number))),
l AS (SELECT rid, min(tier) AS best, list(DISTINCT label) AS labels FROM k GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(l.labels, [])))), ',') AS labels,
  CASE WHEN best = 1 THEN {SCORES[0]} WHEN best = 2 THEN {SCORES[1]} WHEN best = 3 OR b.n > 0 THEN {SCORES[2]} ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)"""
