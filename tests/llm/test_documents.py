"""Token counts, near duplicates, toxicity and packing, against brute force and on odd rows."""

import collections
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import MEDIUM, SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.llm import bagminhash, components, packing, shingles, tokens, toxicity

GAPS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return [w for w in GAPS.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def bag(text, size=5):
    w = plain_words(text)
    return collections.Counter(tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)) if w else collections.Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


# --- token counts


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(tokens.MODEL_FILE):
        pytest.skip("no vocabulary file")
    return tokens.load()


def slow_count(vocabulary, text):
    """Dynamic programming over all substrings, in the order of their starts."""
    if not text:
        return 0, 0.0
    text = tokens.SPACE + text.replace(" ", tokens.SPACE)
    scores = dict(vocabulary.pieces)
    best = [(0.0, 0)] + [None] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 48) + 1):
            if text[i:j] in scores and (best[j] is None or best[i][0] + scores[text[i:j]] > best[j][0]):
                best[j] = (best[i][0] + scores[text[i:j]], best[i][1] + 1)
        if text[i] not in scores and (best[i + 1] is None or best[i][0] + vocabulary.unknown > best[i + 1][0]):
            best[i + 1] = (best[i][0] + vocabulary.unknown, best[i][1] + len(text[i].encode()))
    return best[-1][1], best[-1][0]


def test_counts_equal_slow_search_and_a_unigram_library(vocabulary):
    from tokenizers import Tokenizer, models

    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.pieces, *((f"<0x{i:02X}>", -1e9) for i in range(256))], 0, True))
    counter = tokens.Counter(vocabulary)
    for text in ("Hello  world", "a", "   ", "日本ሴ\n\tx", "▁ ▁", "thththe the-the's", "naïve café " * 20, "x" * 300):
        n, score = counter.count(text)
        assert (n, score) == slow_count(vocabulary, text) == counter.search(tokens.SPACE + text.replace(" ", tokens.SPACE))
        assert n == len(library.encode(tokens.SPACE + text.replace(" ", tokens.SPACE)).ids)


def test_scores_of_merges_follow_their_places(vocabulary):
    scores = [s for _, s in vocabulary.pieces]
    assert abs(scores[0] + math.log(tokens.ZIPF)) < 1e-6 and scores == sorted(scores, reverse=True) and len(scores) > 30_000


def test_counts_are_near_those_of_the_merges(vocabulary):
    import duckdb
    import sentencepiece

    merges = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL_FILE)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()]
    counter = tokens.Counter(vocabulary)
    own, other = np.array([counter.count(t)[0] for t in texts]), np.array([len(merges.encode(t)) for t in texts])
    assert abs(own.sum() / other.sum() - 1) < 0.02 and np.median(np.abs(own - other) / np.maximum(other, 1)) < 0.02


def test_token_counts_ignore_other_columns(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_tokens int, c string")
    assert [tuple(r) for r in tokens.token_counts(df).collect()] == [(1, *tokens.Counter(vocabulary).count("a b"))]


@given(st.lists(st.tuples(st.text("ab▁c", min_size=1, max_size=3), st.integers(-5, 0).map(float)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.text("ab cd", max_size=12))
@settings(max_examples=200, deadline=None)
def test_ties_and_pieces_across_spaces(pieces, text):
    v = tokens.Vocabulary(tuple(pieces))
    assert tokens.Counter(v).count(text) == slow_count(v, text)


def test_token_counts_of_odd_rows(spark, vocabulary):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "word " * 30_000)]
    got = {(r.doc_id, r.n_tokens) for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (2, 0), (None, tokens.Counter(vocabulary).count("a b")[0]), (3, tokens.Counter(vocabulary).count("word " * 30_000)[0])}
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- near duplicates


def test_shingles_equal_plain_ones():
    texts = ["The cat, the Cat! the cat the cat the", None, "", "one two", "é日本 x-ray 42", "a " * 9]
    for (_, h, n, bounds), size in ((x, s) for s in (1, 3) for x in shingles.of_column(pa.array(texts), s)):
        for i, t in enumerate(texts):
            assert sorted(n[bounds[i] : bounds[i + 1]].tolist()) == sorted(bag(t, size).values())
    pieces = list(shingles.of_column(pa.array(texts), 2))
    small = [(h.tolist(), n.tolist()) for _, d, o in shingles.chunks(pa.array(texts), 1) for h, n, _ in [shingles.multisets(*shingles.shingle_hashes(*shingles.word_hashes(d, o), 2))]]
    assert [x for h, _ in small for x in h] == pieces[0][1].tolist()


def test_signatures_are_unbiased_on_weights():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(12):
        a = {int(k): int(w) for k, w in zip(rng.integers(1, 2**60, 40), rng.integers(1, 200, 40), strict=True)}
        b = {k: max(1, int(w * rng.uniform(0.3, 1.6))) for k, w in list(a.items())[:32]} | {int(k): 20 for k in rng.integers(1, 2**60, 8)}
        keys = [np.array(sorted(x), np.uint64) for x in (a, b)]
        counts = [np.array([x[int(k)] for k in ks]) for x, ks in zip((a, b), keys, strict=True)]
        _, names = bagminhash.signatures(np.concatenate(keys), np.concatenate(counts), np.array([0, len(keys[0]), len(keys[0]) + len(keys[1])]), 2048)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        errors.append((names[0] == names[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.05


def brute_classes(rows, least=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(set)
    for i, b in enumerate(bags):
        for s in b:
            holders[s].add(i)
    by_text = {}
    for i, (_, t) in enumerate(rows):
        j = by_text.setdefault(t or "", i)
        parent[find(i)] = find(j)
    for i, b in enumerate(bags):
        for j in {j for s in b for j in holders[s] if j < i}:
            if jaccard(b, bags[j]) >= least:
                parent[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        classes[find(i)].append(d)
    return {find(i): min((d for d in classes[find(i)] if d is not None), default=None) for i in range(len(rows))}, find


def test_classes_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    names, find = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()}
    assert got == {d: names[find(i)] for i, (d, _) in enumerate(rows)}


def test_large_group_odd_rows_and_both_joins(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.008 else f"x{i}" for w in base)) for i in range(60)]  # near each other to different degrees
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, None), (201, ""), (202, " ."), (203, "one two"), (204, "One, two"), (5, rows[5][1]), (None, rows[9][1]), (None, "alone by itself here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "id": F.lit(2)})
    names, find = brute_classes(rows)
    want = collections.Counter((d, names[find(i)]) for i, (d, _) in enumerate(rows))
    for few in (0, 300_000):
        assert collections.Counter((r.doc_id, r.class_id) for r in bagminhash.near_duplicates(df, broadcast_rows=few).collect()) == want
    kept = bagminhash.deduplicated(df).collect()
    assert sorted((repr(r.doc_id) for r in kept)) == sorted(repr(names[c]) for c in {find(i) for i in range(len(rows))})
    assert kept[0].__fields__ == df.columns


def test_pairs_in_large_buckets_of_lesser_similarity(spark):
    common = " ".join(f"c{i}" for i in range(170))
    own = [[f"w{n}x{i}" for i in range(22)] for n in range(400)]
    for n in range(0, 60, 2):
        own[n + 1][:2] = own[n][:2]  # 168 of 208 shingles in common, 0.81; all others have 166 of 210, 0.79
    rows = [(n, f"{common} {' '.join(w)}") for n, w in enumerate(own)]
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {n: n - n % 2 if n < 60 else n for n in range(400)}


def links(rows, least=0.8):
    """Of each text, how many others are near to it."""
    bags = [bag(t) for _, t in rows]
    return [sum(jaccard(a, b) >= least for j, b in enumerate(bags) if i != j) for i, a in enumerate(bags)]


@pytest.mark.parametrize(("small", "n_texts"), [(0, 150), (32, 300), (1000, 150)])
def test_a_hub_joins_texts_that_are_apart(spark, monkeypatch, small, n_texts):
    """One text is at 0.81 to all others, which are below 0.8 to each other; the size of buckets changes nothing."""
    monkeypatch.setattr(bagminhash, "SMALL", small)
    common = " ".join(f"c{i}" for i in range(300))
    rows = [(n, f"{common} " + " ".join(f"w{n}x{i}" for i in range(25 if n == 137 else 45))) for n in range(n_texts)]
    assert links(rows[137:138] + rows[:3]) == [3, 1, 1, 1]
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}
    assert next(r.n_verified for r in got if r.doc_id == 137) == n_texts - 1  # every link of the hub was verified


def test_a_cluster_of_mutual_copies_is_one_class(spark):
    rows = [(n, " ".join(f"x{n}" if i == 6 * n + 7 else f"w{i}" for i in range(400))) for n in range(60)]  # a word of each is its own
    assert min(links(rows)) == 59
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and all(1 <= r.n_verified <= 59 for r in got)


def test_tables_of_steps_are_deleted(spark):
    import os

    from logweir.llm import store

    at = f"{store.shared_dir(spark)}/logweir"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = set(os.listdir(at)) if os.path.exists(at) else set()
    n = bagminhash.deduplicated(docs).count()
    left = {x.split("-")[0] for x in set(os.listdir(at)) - before}
    assert left <= {"gone", "classes"} and n


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bagminhash.near_duplicates(empty).count() == bagminhash.deduplicated(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    parent = list(range(300))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    many = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), piece=20).collect()}
    assert many == got


# --- toxicity


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.96
    assert not [r for r in rows if r.predicted and not r.toxic]
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.85


def voted(spark):
    """(votes, guesses, labels of the sampled texts) at the medium size; labels are 1, 0 or nan."""
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 4000, 8000)
    toxic = F.col("gold")
    n1, n0 = sample.agg(F.count_if(toxic == 1), F.count_if(toxic == 0)).first()
    sums = toxicity.term_sums(sample.where("gold is not null").select("text", toxic.alias("toxic")))
    groups, _ = toxicity._lexicons(toxicity._differing(sums, n1, n0), n1, n0)
    table = toxicity._voted(sample, groups)
    gold = table["gold"].to_numpy().astype(float)
    return *toxicity.voter_guesses(np.array(table["dense"].to_pylist(), float), np.array(table["shouts"].to_pylist(), bool), gold), gold


def test_voters_without_labels_of_texts_beat_chance(spark):
    votes, _, gold = voted(spark)
    assert np.isnan(gold).mean() > 0.5  # most texts have no label
    # one and the same guess for every voter, and next to no weight on it: the votes alone tell who is right
    post, right, _ = toxicity.label_model(votes, 0.2, np.full((2, votes.shape[1]), 0.7), 2.0)
    balanced = ((post[gold == 1] >= 0.5).mean() + (post[gold == 0] < 0.5).mean()) / 2
    assert balanced >= 0.7  # chance is 0.5
    assert (post[gold == 0] >= 0.5).mean() < 0.1


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r.doc_id: r.score for r in toxicity.scored(docs, x).collect()}
    assert score(labels) == score(other)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "you idiot"), (4, "fine " * 30_000)], "doc_id long, text string")
    some = spark.createDataFrame([(1, 0), (4, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    for labels in (some, some.limit(0)):
        got = toxicity.scored(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert toxicity.scored(docs.limit(0), labels).count() == 0
        assert toxicity.accepted(docs, labels).columns == docs.columns
    bad = {r.doc_id for r in toxicity.scored(docs, some.limit(0)).collect() if r.predicted}
    assert bad == {None}


def test_toxicity_ignores_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    clash = {c: F.lit("x") for c in ("id", "gold", "score", "toxic", "node", "predicted", "held_out")}
    plain = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert {r.doc_id: r.score for r in toxicity.scored(docs.withColumns(clash), labels.withColumns({k: v for k, v in clash.items() if k != "toxic"})).collect()} == plain
    kept = toxicity.accepted(docs.withColumns(clash), labels)
    assert kept.columns == docs.columns + list(clash) and {r.doc_id for r in kept.collect()} == {d for d, s in plain.items() if s < toxicity.THRESHOLD}


def test_sums_of_terms_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", (F.col("doc_id") % 2).cast("double").alias("toxic"))
    one, many = ({(r.bucket, r.kind, r.toxic, r.other) for r in toxicity.term_sums(docs.repartition(n)).collect()} for n in (1, 7))
    assert one == many


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    right = [0.95, 0.85, 0.75, 0.75]
    votes = np.stack([np.where((rng.random(4000) < p) == y, 1, -1) for p in right] + [np.where(rng.random(4000) < 0.3, np.where(y, 1, -1), 0)], axis=1)
    votes = np.insert(votes, 4, votes[:, 3], axis=1)  # a copy must not count twice
    post, found, weight = toxicity.label_model(votes, 0.3, np.full((2, 6), 0.7))
    assert ((post > 0.5) == y).mean() > 0.95
    assert abs(found[0, 0] - 0.95) < 0.06 and abs(found[0, 1] - 0.85) < 0.06  # the discount of copies pulls them in a little
    assert weight[3] < weight[0]
    assert len(toxicity.label_model(votes[:0], 0.3, np.full((2, 6), 0.7))[0]) == 0


# --- packing


def brute_pack(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        i = min(fits)[1] if fits else len(bins) - 1
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4])), max_size=40))
@settings(max_examples=200, deadline=None)
def test_pack_equals_brute_force(rows):
    sizes, sources, clusters = ([r[i] for r in rows] for i in range(3))
    assert list(zip(*packing.pack(sizes, sources, clusters, 20), strict=True)) == brute_pack(sizes, sources, clusters, 20)


def check_packed(rows, lengths, sources, capacity):
    for d, pieces in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.piece)), lambda r: r.doc_id):
        pieces = list(pieces)
        assert [p.first_token for p in pieces] == [i * capacity for i in range(len(pieces))]
        assert sum(p.n_tokens for p in pieces) == lengths[d]
    for _, own in itertools.groupby(sorted((r for r in rows if r.bin_id), key=lambda r: (r.bin_id, r.offset)), lambda r: r.bin_id):
        own = list(own)
        end = 0
        for r in own:
            assert r.offset == end
            end += r.n_tokens
        assert end <= capacity
        assert len({sources[r.doc_id] for r in own}) == len(own)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = packing.packed(docs, capacity=512, shard_rows=300).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check_packed(rows, {d: len(plain_words(r.text)) for d, r in texts.items()}, {d: r.source for d, r in texts.items()}, 512)


def test_shards_are_bounded_by_pieces(spark):
    docs = spark.createDataFrame([(i, "word " * 60_000, f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    for options in ({}, {"length": F.size(F.split(F.trim("text"), " "))}):
        rows = packing.packed(docs, capacity=100, shard_rows=500, **options).collect()
        per = collections.Counter(r.shard for r in rows)
        assert len(rows) == 7200 and max(per.values()) < 800


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", 5), (2, "", "s", 5), (3, "a b c", None, 5), (3, "a b c", None, 5), (None, "A b, c", None, 5), (5, "x " * 5000, "s", 5)], "doc_id long, text string, source string, bin int")
    rows = packing.packed(docs, capacity=1000).collect()
    assert sorted(repr((r.doc_id, r.n_tokens, r.bin_id is None)) for r in rows) == sorted(map(repr, [(1, 0, True), (2, 0, True), (3, 3, False), (3, 3, False), (None, 3, False), *[(5, 1000, False)] * 5]))
    same = [r.bin_id for r in rows if r.n_tokens == 3]
    assert len(set(same)) == 3  # copies are kept apart
    assert packing.packed(docs.limit(0)).count() == 0
