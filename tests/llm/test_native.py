"""Secret scans, license scans and decontamination, against DuckDB and on odd rows."""

import re

import pytest
from conftest import SMALL, rows_equal
from pyspark.sql import functions as F

from logweir.llm import decontaminate, licenses, queries, secrets

DOCS = "doc_id long, text string, source string, `row` string, `key` int, `hash` string, n_words string, items string, labels string"
TEXTS = [
    None,
    "",
    " \n",
    "token = abc12 token=token:abcdef PASSWORD: 'hunter2hunter2'",
    "AKIA" + "A" * 16 + " and AKIAAAA, " + "0123456789abcdef" * 3 + "é日本" + "a" * 24,
    "secret=" + "x" * 50_000,
    "kennwort api_key:abcdef apikey='zzzzzz' https://me:pass1@host/ ghp_" + "a" * 36,
    "Released under the MIT License. mit license, Mit-License; permit license GNU General Public License v3",
    "Apache License, Version 2.0 " * 300 + "SPDX-License-Identifier: MIT",
    "word " * 20_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", "r", i, "h", "n", "x", "l") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:5] + [(None, "password=abcdefg", None, None, None, None, None, None, None)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    rows_equal(queries.QUERIES[name](spark, SMALL), *duck(queries.ORACLE_SQL[name], SMALL))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb_on_odd_rows(spark, duck, odd, tmp_path, name):
    odd.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    items = spark.createDataFrame([(1, "kennwort api_key"), (1, "mit license mit license permit license gnu general public license v3 and more"), (None, "hunter2hunter2"), (3, None), (4, "..."), (5, "word " * 12)], "item_id long, text string")
    items.coalesce(1).write.parquet(str(tmp_path / "b"))
    for kind, to in (("d", "documents"), ("b", "benchmark")):
        next((tmp_path / kind).glob("*.parquet")).rename(tmp_path / f"{to}.parquet")
    import shutil

    shutil.rmtree(tmp_path / "d")
    shutil.rmtree(tmp_path / "b")
    rows_equal(queries.QUERIES[name](spark, str(tmp_path)), *duck(queries.ORACLE_SQL[name], str(tmp_path)))


def test_shuffled_way_equals_broadcast(spark, odd):
    items = spark.createDataFrame([(1, "kennwort api_key"), (2, "word " * 12)], "item_id long, text string")
    for few, many in (
        (secrets.digest(odd), secrets.digest(odd, broadcast_rows=0, block=2)),
        (decontaminate.digest(odd, items), decontaminate.digest(odd, items, broadcast_rows=0)),
    ):
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


def test_extra_columns_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "kennwort api_key")], "item_id long, text string")
    for df in (odd, odd.limit(0)):
        n = df.count()
        assert secrets.scan(df).count() == licenses.scan(df).count() == decontaminate.hits(df, items).count() == decontaminate.hits(df, items.limit(0)).count() == n
    assert secrets.scan(odd).columns == odd.columns + ["secrets"]


def test_trigram_queries_admit_all_matches():
    for rule, text in (("assign", 'Api_Key"= "abcdef'), ("pem", "-----BEGIN RSA PRIVATE KEY-----"), ("login", "ftp://a:bcd@"), ("package", "npm_" + "a" * 36), ("webtoken", "eyJaaaaaaaa.eyJaaaaaaaa.aaaaaaaa")):
        pattern = next(r.pattern for r in secrets.RULES if r.kind == rule)
        assert re.search(pattern, text)

        def holds(q):
            return q in text.lower() if isinstance(q, str) else (all if q[0] == "and" else any)(map(holds, q[1])) if q[1] else True

        query = secrets.trigram_query(pattern)
        assert holds(query)
        assert query != secrets.ANY
    assert secrets.trigram_query(r"[0-9a-f]+") == secrets.ANY


def test_masked_keeps_the_rest(spark, odd):
    got = {r.doc_id: r.text for r in secrets.masked(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert got[0] is None and got[1] == ""
    assert got[3] == "token = abc12 token=token:abcdef [SECRET]'"
    assert got[4].startswith("[SECRET] and AKIAAAA, [SECRET]é日本[SECRET]")
    assert got[9] == TEXTS[9]


def test_clean_drops_leaks_only(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x a b y"), (3, None), (4, "b a"), (1, "fine"), (4, "b a"), (None, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a, b")], "item_id long, text string")
    for few in (0, 1000):
        assert sorted((r.doc_id, r.text) for r in decontaminate.clean(docs, items, broadcast_rows=few).collect() if r.doc_id != 3) == [(1, "fine"), (4, "b a"), (4, "b a")]


def test_license_containment_and_priority(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: Apache-2.0"), (2, "Licensed under the GNU Lesser General Public License, version 2.1"), (3, "see the BSD license; also licensed under CC BY-NC-SA 4.0")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).select("doc_id", "labels", F.col("score")).collect()}
    assert got == {1: ("apache-2.0", 1.0), 2: ("gpl,lgpl-2.1", 0.9), 3: ("bsd,cc-by-nc-sa-4.0", 0.9)}


def example(expression):
    """A text that the expression matches: the first way of each choice, and nothing that may be left out."""
    out = ""
    for op, x in licenses.sre.parse(expression) if isinstance(expression, str) else expression:
        if op == licenses.sre.LITERAL:
            out += chr(x)
        elif op == licenses.sre.IN:
            out += chr(x[0][1] if x[0][0] == licenses.sre.LITERAL else x[0][1][0])
        elif op == licenses.sre.SUBPATTERN:
            out += example(x[-1])
        elif op == licenses.sre.BRANCH:
            out += example(x[1][0])
        elif op in (licenses.sre.MAX_REPEAT, licenses.sre.MIN_REPEAT):
            out += example(x[2]) * max(x[0], 0)
    return out


def test_every_rule_fires_on_its_own_example(spark):
    rules = licenses.rules()
    texts = [example(e).replace("  ", " ").strip() for _, _, _, e in rules]
    assert len(rules) > 400 and all(re.search(e, " " + "  ".join(t.split()) + " ") for (_, _, _, e), t in zip(rules, texts, strict=True))
    docs = spark.createDataFrame([(i, f"A file. {t.capitalize()}, as it is.") for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in licenses.scan(docs).select("doc_id", "labels", "score").collect()}
    for i, (tier, label, _, _) in enumerate(rules):
        labels, score = got[i]
        same = {x for t, x, _, e in rules if t <= tier and re.search(e, " " + "  ".join(texts[i].split()) + " ")}
        assert label in labels or labels & same, texts[i]
        assert score >= licenses.SCORES[tier - 1]
    assert sum(label in got[i][0] for i, (_, label, _, _) in enumerate(rules)) > 0.95 * len(rules)


def test_names_and_passages_without_the_word_license(spark):
    want = {
        "All rights reserved.": "all-rights-reserved",
        "Released under the WTFPL": "wtfpl",
        "published under CC0 1.0 Universal": "cc0-1.0",
        "CreativeML OpenRAIL-M": "openrail",
        "NASA Open Source Agreement": "nasa-1.3",
        "MIT No Attribution": "mit-0",
        "GNU GPLv3": "gpl-3.0",
        "Licensed under MIT.": "mit",
        "Zero-Clause BSD": "0bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the ": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "This is a permit for the committee. Rights and duties; the domain is public, the common attribution is free.": "",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == list(want.values())


def test_gates_admit_all_matches():
    rules = licenses.rules()
    gates = licenses.gates(rules)
    for _, label, key, e in rules:
        assert key in example(e) and licenses.piece(key, e) in example(e), (label, e)
        assert any(g in example(e) for g in gates)
