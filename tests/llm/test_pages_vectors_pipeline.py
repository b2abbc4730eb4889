"""HTML extraction, URL filters, vector search and the pipeline."""

import collections
import math
import random
import time

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_documents import brute_classes, plain_words

from logweir.llm import decontaminate, htmltext, urls, vptree

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><div class="cookie-notice">We use cookies.</div><div id="page">
%s
</div><div class="sidebar"><p>Some other long text that isn't part of this article at all, really.</p></div>
<section id="comments"><p>First! A comment by a reader that goes on for quite a while.</p></section>
<form><label>Mail</label><input><button>Send</button></form><script>var t = "<p>no</p>";</script><footer>&copy; me</footer></body></html>"""
BODY = "<h2>A &amp; B&nbsp;C</h2><p>First   line\nbroken <b>bold <i>deep</i></b> text with a <a href=x>link</a> in it, going on and on.<p>Second<br>one, &eacute;t&eacute; &#x65E5; without an end tag<ul><li>item one is here<li>item two is there</ul><table><tr><td>cell a<td>cell b</table>"
WANT = "A & B C\n\nFirst line broken bold deep text with a link in it, going on and on.\n\nSecond one, été 日 without an end tag\n\nitem one is here\n\nitem two is there\n\ncell a\n\ncell b"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=post>%s</div>"])
def test_article_is_found(wrap):
    assert htmltext.extract(PAGE % (wrap % BODY)) == WANT


@pytest.mark.parametrize("wrap", ["<article class='post has-sidebar'>%s</article>", "<div id=content class='with-comments'>%s</div>", "<div class='page header-fixed'>%s</div>", "<div class=search-result>%s</div>", "<div class=widget><article>%s</article></div>", "<div class=search>%s</div>"])
def test_class_words_alone_cut_no_article(wrap):
    assert htmltext.extract(PAGE % (wrap % BODY)) == WANT


@pytest.mark.parametrize("wrap", ["<div class='content with-sidebar'>%s</div>", "<div class='page no-sidebar'>%s</div>", "<div class='post has-share'>%s</div>", "<article class='hentry comment-open'>%s</article>", "<div class='ad-free article'>%s</div>"])
def test_words_within_tokens_cut_nothing(wrap):
    assert htmltext.extract(PAGE % (wrap % BODY)) == WANT


LONG = " ".join(f"word{i}" for i in range(60))


def test_density_decides_without_article_or_main():
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>a page of ours number {i}</a></li>" for i in range(40)) + "</ul></div>"
    text = f"<h2>Title</h2><p>{LONG} one.</p><p>{LONG} two.</p><blockquote>Short.</blockquote><p>{LONG} three.</p>"
    want = f"Title\n\n{LONG} one.\n\n{LONG} two.\n\nShort.\n\n{LONG} three."
    page = f"<body>{links}<div><div><p><a href=/l>Latest</a></p><p><a href=/p>Popular</a></p></div></div><div id=x><div>{text}</div></div><div><p><a href=/i>Imprint</a></p></div>{links}</body>"
    assert htmltext.extract(page) == want
    # an article element that holds next to nothing doesn't decide
    assert htmltext.extract(page.replace("<div><p><a href=/i>Imprint</a></p></div>", "<article><p><a href=/i>Imprint</a></p></article>")) == want


def test_parts_of_an_article_stay_together():
    text = f"<h1>Title</h1><p>Lead.</p><section><h2>First</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><h2>Second</h2><p>Short one.</p></section>in between <b>bold</b> text<section><p>{LONG}</p></section>"
    want = f"Title\n\nLead.\n\nFirst\n\n{LONG}\n\n{LONG}\n\n{LONG}\n\nSecond\n\nShort one.\n\nin between bold text\n\n{LONG}"
    for tag in ("article", "main"):
        assert htmltext.extract(f"<body><nav>menu</nav><div><{tag}>{text}</{tag}></div><footer>f</footer></body>") == want
    assert htmltext.extract(f"<body><div><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div></div></body>") == f"Title\n\n{LONG}\n\n{LONG}"


def slow_measures(node, whole):
    """(block, characters, tags, characters in links, tags in links, density, sum) of a node, each worked out from its children anew."""
    parts = [(x if isinstance(x, str) else slow_measures(x, whole), x) for x in node.children if isinstance(x, str) or not x.cut]
    chars = sum(len(" ".join(m.split())) if isinstance(m, str) else m[1] for m, _ in parts)
    tags = sum(m[2] + 1 for m, _ in parts if not isinstance(m, str))
    link_chars = chars if node.tag == "a" else sum(m[3] for m, _ in parts if not isinstance(m, str))
    link_tags = sum(m[4] for m, _ in parts if not isinstance(m, str)) + (node.tag == "a")
    block = node.tag in htmltext.BLOCKS or any(m[0] for m, _ in parts if not isinstance(m, str))

    def density(c, t, lc, lt):
        if c == 0:
            return 0.0
        t, lt = max(t, 1), max(lt, 1)
        return max(0.0, c / t * math.log(c / max(lc, 1) * t / lt + 1e-9) / math.log(c * lc / max(c - lc, 1) + whole * c + math.e))

    total, runs = 0.0, [[]]
    for m, x in parts if block else ():
        if isinstance(m, str):
            runs[-1].append((len(" ".join(m.split())), 0, 0, 0))
        elif m[0] or x.tag == "br":
            total += m[5]
            runs.append([])
        else:
            runs[-1].append((m[1], m[2] + 1, m[3], m[4]))
    total += sum(density(*(sum(r[i] for r in run) for i in range(4))) for run in runs)
    return block, chars, tags, link_chars, link_tags, density(chars, tags, link_chars, link_tags), total


@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "<br>", "<ul><li>", "</ul>", "<nav>", "</nav>", "some words ", "text", LONG, "</i>"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_density_sums_equal_slow_ones(parts):
    tree = htmltext.Tree()
    tree.feed("".join(parts))
    tree.close()
    nodes = htmltext._measure(tree.root)
    whole = tree.root.link_chars / max(tree.root.chars, 1)
    for n in nodes:
        want = slow_measures(n, whole)
        assert (n.block, n.chars, n.tags, n.link_chars, n.link_tags) == want[:5]
        assert abs(n.density - want[5]) < 1e-9 * (1 + want[5]) and abs(n.total - want[6]) < 1e-9 * (1 + want[6])


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert htmltext.extract("<div>" * 20_000 + "deep" + "</span>" * 20_000 + "</div>" * 20_000) == "deep"
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert htmltext.extract(f"<body><nav>menu</nav><div>{many}</div></body>").count("\n\n") == 4999
    assert time.perf_counter() - began < 30


def test_comments_that_are_articles_stay_cut():
    comments = f"<section class=comments><article>{BODY}</article><article>{BODY}</article></section>"
    assert htmltext.extract(PAGE % (f"<article>{BODY}</article>{comments}")) == WANT


def test_odd_pages():
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<nav><a>x</a></nav>") == ""
    assert htmltext.extract("just text") == "just text"
    assert htmltext.extract("<p>a</b></div><p>b") == "a\n\nb"
    assert htmltext.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert htmltext.extract("<article><p>one</p><div class='advert'>buy</div><p>two</p><article class='comment'>me too</article></article>") == "one\n\ntwo"


def test_fixture_pages_give_their_articles(spark):
    import html
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = htmltext.digest(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_with_odd_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", None)], "page_id long, url string, html string, text string")
    assert [r.text for r in htmltext.extracted(df).collect()] == ["", "", "x"]
    assert htmltext.digest(df.limit(0)).count() == urls.digest(df.limit(0)).count() == 0
    assert urls.digest(df).count() == 3


def plain_judge(url):
    url = url or ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", "", None
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [h + p for h, p, _ in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_equal_plain_python(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()]
    odd = ["HTTP://WWW.Example.COM/en/x?a#b", "http://example.com", "http://com/", "x://notexample.com/en/", "no scheme", "", None, "a://b.net/es/://c", "http://é.net/fr/", "http://net?/es/", "x://example.com#/en/"]
    rows += [(10_000 + i, u) for i, u in enumerate(odd)]
    got = urls.digest(spark.createDataFrame(rows, "page_id long, url string")).collect()
    known = dict(rows)
    verdicts = {h + p: v for h, p, v in urls.RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == plain_judge(known[r.page_id])
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")
        assert (r.score is None) == (r.rule is not None)


def test_trees_learn_lexical_signs():
    rng = random.Random(4)
    good = lambda i: (f"https://www.site{rng.randrange(30)}.org/news/story", 0)
    bad = lambda i: (f"http://win-{rng.randrange(999)}-{rng.randrange(10**6)}.site{rng.randrange(30)}.org/{rng.randrange(10**9)}?a=1&b=2&c={i}", 1)
    rows = [(good if i % 2 else bad)(i) for i in range(600)]
    model = urls.train([u for u, _ in rows[:400]], [y for _, y in rows[:400]])
    scores = model.scores([u for u, _ in rows[400:]])
    assert np.mean((scores > 0.5) == np.array([y for _, y in rows[400:]])) > 0.98
    assert urls.train([], []).scores(["http://a.b/"])[0] == 0.5
    assert urls.train(["http://a.b/"] * 3, [1] * 3).scores(["x"])[0] > 0.8


def slow_tree(x, grad, hess):
    """The best tree by trying every cut of every feature on every node."""
    cuts = urls.cuts_of(x)

    def grow(rows, depth):
        g, h = sum(grad[r] for r in rows), sum(hess[r] for r in rows)
        best = (1e-6, None, None)
        if depth < urls.DEPTH and len(rows) >= 2 * urls.LEAST_ROWS:
            for f, points in enumerate(cuts):
                for c in points:
                    low = [r for r in rows if x[r, f] <= c]
                    if urls.LEAST_ROWS <= len(low) <= len(rows) - urls.LEAST_ROWS:
                        gl, hl = sum(grad[r] for r in low), sum(hess[r] for r in low)
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, c)
        if best[1] is None:
            return dict.fromkeys(rows, -urls.RATE * g / (h + 1))
        low = [r for r in rows if x[r, best[1]] <= best[2]]
        return grow(low, depth + 1) | grow([r for r in rows if x[r, best[1]] > best[2]], depth + 1)

    return grow(list(range(len(x))), 0)


def test_trees_equal_slow_ones():
    rng = np.random.default_rng(5)
    for rows in (8, 40, 150):
        x = np.stack([rng.normal(size=rows), rng.integers(0, 4, rows), np.ones(rows), rng.exponential(size=rows)], axis=1)
        y = (x[:, 0] + x[:, 1] + rng.normal(size=rows) > 1.5).astype(float)
        cuts = urls.cuts_of(x)
        bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
        grad, hess = 0.5 - y, np.full(rows, 0.25)
        want = slow_tree(x, grad, hess)
        assert np.allclose(urls._of_tree(urls.best_tree(bins, cuts, grad, hess), x), [want[r] for r in range(rows)])


def test_labels_that_say_nothing_give_the_prior():
    rng = random.Random(6)
    names = ["https://" + "".join(rng.choices("abcdefgh", k=8)) + f".{rng.choice(['org', 'de'])}/{rng.randrange(10**5)}" for _ in range(400)]
    model = urls.train(names, [rng.randrange(2) for _ in names])
    assert np.abs(model.scores(["https://other.site/1", "http://a.b.c/d?e=f"]) - 0.5).max() < 0.1
    assert model.held_out[1] <= 3


def test_undecided_urls_get_both_verdicts(spark):
    found = urls.digest(spark.read.parquet(f"{MEDIUM}/pages.parquet")).where("rule is null").collect()
    by = collections.Counter(r.verdict for r in found)
    assert min(by["allow"], by["block"]) > 0.1 * len(found)
    seeds = [(u, k) for k, own in enumerate(urls.SEEDS) for u in own]
    accuracy, trees = urls.train(*map(list, zip(*seeds, strict=True))).held_out
    assert accuracy >= 0.8 and trees > 0


def test_very_long_urls(spark):
    long = "http://a.org/" + "x/" * 200_000 + "?" + "p=1&" * 50_000
    r = urls.digest(spark.createDataFrame([(1, long), (1, long)], "page_id long, url string")).collect()
    assert len(r) == 2 and r[0].host == "a.org" and len(r[0].path) == 400_001 and r[0].verdict in ("allow", "block")


# --- vectors


def brute_nearest(rows, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            near = sorted(((-float((w * v).sum()), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_factor_one_is_exact_and_production_recalls(spark):
    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    exact = found(vptree.digest(df, factor=1.0, shard_rows=60, cells=5))
    assert {q: [i for i, _ in v] for q, v in exact.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(exact[q], want[q], strict=True))
    near = found(vptree.digest(df))
    assert np.mean([len({i for i, _ in near[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


@pytest.mark.parametrize("scales", ["one long", "very long", "mixed"])
def test_recall_does_not_depend_on_lengths(spark, scales):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    times = np.exp(rng.normal(size=len(rows))) if scales == "mixed" else np.ones(len(rows))
    times[20] = 1e5 if scales == "very long" else 20
    rows = [(i, (np.array(v, float) * t).tolist()) for (i, v), t in zip(rows, times, strict=True)]
    want = brute_nearest(rows)
    near = found(vptree.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert min(np.mean([len({i for i, _ in near[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in part]) for part in (list(want), [rows[20][0]] if rows[20][0] in want else list(want))) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 0.5, 0.25]) for i in range(100, 190)]  # one vector many times
    rows += [(200, None), (201, [0.0] * 4), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [float("inf")] * 4), (204, [None, 1.0, 2.0, 3.0]), (220, [1.0, 2.0]), (240, []), (None, [1.0] * 4), (221, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for options in ({}, {"shard_rows": 20}, {"shard_rows": 20, "cells": 2}):
        got = found(vptree.digest(df, factor=1.0, **options))
        want = brute_nearest(rows)
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert vptree.digest(df.limit(0)).count() == 0


def test_ties_go_to_smaller_ids(spark, monkeypatch):
    """Vectors on axes of their own: all scores are 0, or 1 for one another's copies."""
    rows = [(i, [1.0 if j == i % 300 else 0.0 for j in range(300)]) for i in range(330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit("x"), "size": F.lit(1), "cell": F.lit(2), "ids": F.lit(3), "bound": F.lit(0.5), "query": F.lit("q")})
    want = {q: [i for i, _ in v] for q, v in brute_nearest(rows).items()}
    monkeypatch.setattr(vptree, "BATCH_ROWS", 3)
    for options in ({}, {"shard_rows": 50}, {"shard_rows": 50, "cells": 2}):
        assert {q: [i for i, _ in v] for q, v in found(vptree.digest(df, factor=1.0, **options)).items()} == want


def test_a_common_vector_is_one_point(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=6).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    want = {q: [i for i, _ in v] for q, v in brute_nearest(rows).items()}
    assert {q: [i for i, _ in v] for q, v in found(vptree.digest(df, factor=1.0, shard_rows=100)).items()} == want


def test_cells_admit_whatever_is_nearer():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)) * np.exp(rng.normal(size=(400, 1)))
    c = vptree.Cells(x[:12], float((x**2).sum(axis=1).max()) * (1 + 1e-9))
    cell, apart = c.nearest(x)
    for i in range(12):
        own = cell == i
        c.count[i], c.low[i], c.high[i], c.least[i] = own.sum(), apart[own].min(initial=np.inf), apart[own].max(initial=0), np.sqrt((x[own] ** 2).sum(axis=1)).min(initial=np.inf)
    q = rng.normal(size=(50, 5))
    most, scores = c.admitted(q, 1.0), q @ x.T
    for i in range(12):
        if c.count[i]:
            assert (most[:, i] >= scores[:, cell == i].max(axis=1) - 1e-9).all()


def test_tree_prunes_and_factor_relaxes():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8)) * 5
    x = centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 8)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]  # as embeddings usually are
    tree = vptree.Tree(x, float((x**2).sum(1).max()) * 1.001, leaf=32)
    q = x[:40]
    d, rows = tree.search(q, 10, 1.0)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert all(set(a) == set(b) for a, b in zip(rows.tolist(), true.tolist(), strict=True))
    recall = [np.mean([len(set(a) & set(b)) / 10 for a, b in zip(tree.search(q, 10, f)[1].tolist(), true.tolist(), strict=True)]) for f in (1.0, 1.1, 3.0)]
    assert recall[0] == 1.0 and recall[1] >= 0.9 and recall[2] <= recall[1]


# --- pipeline


def test_stages_one_by_one(spark, tmp_path):
    import corpus_pipeline as cp

    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 0").collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert toxic <= ids[0] < every  # clean documents stay
    rows = [(r.doc_id, r.text) for r in kept[0].collect()]
    names, find = brute_classes(rows)
    assert ids[1] == {names[find(i)] for i in range(len(rows))}
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = plain_words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 10, 0) + 1)} if w else set()
    leaks = set()
    for r in kept[1].collect():
        w = plain_words(r.text)
        if any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            leaks.add(r.doc_id)
    assert ids[2] == ids[1] - leaks and leaks
    assert ids[3] == ids[2] == ids[4]
    masked = {r.doc_id: r for r in kept[3].collect()}
    assert all(r.n_chars == len(r.text) for r in masked.values())
    changed = {r.doc_id for r in kept[2].collect() if masked[r.doc_id].text != r.text}
    assert changed == {r.doc_id for r in kept[2].collect() if "token=" in r.text and "[SECRET]" in masked[r.doc_id].text}
    assert decontaminate.WINDOW == 10


def test_pipeline_run(spark):
    import corpus_pipeline as cp

    rows = cp.run(spark, SMALL)
    assert rows.count() > 100 and "bin_id" in rows.columns


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, None, "s", None, "x"), (2, "", "en", None, 0, "x"), (3, "password=abcdefgh " + long, "en", "s", 9, "x"), (None, "alone here", None, None, None, None), (4, "a text that comes twice", "en", "s", 9, "x"), (4, "a text that comes twice", "en", "s", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `node` string").withColumns({"id": F.lit(7), "score": F.lit(0.5), "secrets": F.lit("s"), "row": F.lit("r")})
    for frame in (docs, docs.limit(0)):
        now = frame
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, now, str(tmp_path))
            if i < len(cp.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{i}-{frame is docs}"))
            now = spark.read.parquet(str(tmp_path / f"{i}-{frame is docs}"))
            if frame is docs and i == 3:
                texts = {r.doc_id: r.text for r in now.collect()}
                assert set(texts) == {None, 1, 3, 4} and texts[3] == "[SECRET] " + long and now.count() == 4
        assert now.select("doc_id").distinct().count() == (4 if frame is docs else 0)
