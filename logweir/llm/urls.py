"""URL filters: rules by host and path first, then gradient-boosted trees on lexical features.

The trees learn from labelled URLs: pairs of url and label that the caller gives, or else a few
fixed ones and the URLs that the rules decide. Host, path and rule are column expressions; only
URLs that no rule fits are scored by the trees.

Hosts are dealt to folds. The rate of blocks by suffix that a URL learns with comes from the other
folds, so that no URL tells its own label, and is drawn to the prior by as much as PRIOR_ROWS
further rows. Trees are added only while they lower the loss on the hosts of folds that weren't
learnt from: what the labels say nothing about stays near the prior, which allows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower

# Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Labelled URLs to begin with, made up after the ways of ordinary sites and of spam; first those to allow, then those to block.
SEEDS = (
    (
        "https://www.city-library.org/opening-hours https://news.daily-herald.org/world/2023/article https://blog.gardeners.net/en/roses https://museum.example.edu/visit https://www.weather.gov.org/forecast http://history.society.org/papers/12 "
        "https://m.radio.org/programme https://docs.toolkit.org/guide/install.html https://school.net/de/termine https://www.bakery.org/recipes/bread https://en.cyclopedia.org/wiki/Rivers http://choir.org/concerts?page=2 "
        "https://forum.sailing.net/threads/4711 https://www.clinic.org/contact#map https://travel.stories.net/de/891 https://science.journal.org/volume/7/issue/2 https://community.theatre.org/en/4402.html http://www.volunteers.org/join "
        "https://local.paper.net/en/118?utm_source=feed https://www.birdwatch.org/species/owl https://chess.club.org/games/93 https://poetry.magazine.org/archive/ https://www.observatory.org/images?page=2&ref=x https://orchard.farm.net/apples"
    ).split(),
    (
        "http://best-casino-bonus.org/win?aff=99182 http://www.free-slots-4u.net/play?id=8841&ref=77120&src=ad http://cheap-meds-now.org/buy?item=20mg&qty=90 http://click-track.net/r?u=8f3a99b2c1&s=77&k=5 http://hot-singles-tonight.org/join?cam=19 http://m.poker-win.net/en/99 "
        "https://buy-followers-fast.net/p/1000?coupon=x9 http://loan-approval-24h.org/apply?ssn=1&id=2&t=3 https://ad-server-7.net/c/91823/77182?cb=118273 http://lucky-spin-777.org/ http://replica-watches-shop.net/sale/70-off http://payday-cash.org/now "
        "http://seo-link-farm.net/out/12 http://adult-cams-live.org/room/5512 http://pills-online-24.net/en/12/ http://win-iphone-free.org/claim?uid=8821731 http://bets-bonus.net/de/55 http://x-videos-hd.org/watch?v=99&a=1&b=2 "
        "http://track-ads.net/pixel.gif?id=7123&e=9912&z=1 http://cheap-tickets-cheap.org/go?r=1 http://spam-pages.net/en/883 http://crypto-double-now.org/send?wallet=0x99ab12 http://game-hack-free.net/dl/77 http://miracle-diet-tips.org/order?x=1&y=2"
    ).split(),
)
#: Labelled URLs that the trees are fitted on, at most.
SAMPLE_ROWS = 10_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 40, 3, 0.2, 32, 5
FOLDS, PRIOR_ROWS = 5, 5
#: A URL that no rule decides is blocked from this score on; the prior is 0.5.
THRESHOLD = 0.6
FEATURES = ("length", "host length", "path depth", "digit ratio", "entropy", "parameters", "host labels", "hyphens", "suffix rate", "suffix count", "path length", "fragment", "scheme")


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(at: Column, on: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; rules that are equally long go by their text."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((at == h) | at.endswith("." + h)) & on.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _parts(url: str) -> tuple[str, str, str, str, str]:
    scheme, sep, rest = url.partition("://")
    if not sep:
        scheme, rest = "", url
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    at, slash, p = rest.partition("/")
    return scheme, at.lower(), slash + p, query, fragment


def suffix(url: str) -> str:
    return ".".join(_parts(url)[1].split(".")[-2:])


def features(urls: list[str | None], stats: dict[str, tuple[float, int]], prior: float) -> np.ndarray:
    """One row of FEATURES for each URL; null counts as empty. stats: rate of blocks and count by suffix."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, url in enumerate(urls):
        url = url or ""
        scheme, at, p, query, fragment = _parts(url)
        n = max(len(url), 1)
        counts = Counter(url)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        rate, seen = stats.get(suffix(url), (prior, 0))
        out[i] = (len(url), len(at), p.count("/"), sum(c.isdigit() for c in url) / n, entropy, query.count("&") + 1 if query else 0, at.count(".") + 1, at.count("-"), rate, math.log1p(seen), len(p), bool(fragment), scheme == "https")
    return out


@dataclass(frozen=True)
class Trees:
    stats: dict
    prior: float
    bias: float
    #: Each tree: (feature, threshold, left, right, value) by node, a leaf having feature -1.
    trees: tuple = ()
    #: Share of labelled URLs that trees which haven't seen their hosts judge right, and how many trees were best; nan without labels.
    held_out: tuple[float, int] = (math.nan, 0)

    def scores(self, urls: list[str | None]) -> np.ndarray:
        x = features(urls, self.stats, self.prior)
        return 1 / (1 + np.exp(-self.bias - sum((_of_tree(t, x) for t in self.trees), np.zeros(len(urls)))))


def _of_tree(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = tree
    at = np.zeros(len(x), int)
    for _ in range(DEPTH):
        inner = feature[at] >= 0
        go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)
    return value[at]


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Up to BINS - 1 cuts of each feature, at quantiles; not at the largest value, which cuts nothing off."""
    found = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    return [c[c < top] for c, top in zip(found, x.max(axis=0), strict=True)]


def best_tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple:
    """One regression tree on gradients, by the best second-order gain over binned cuts; of equal gains the first feature's least cut."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, -RATE * g / (h + 1.0)])
        best = (1e-6, -1, 0)
        if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for f, points in enumerate(cuts):
                if not len(points):
                    continue
                size = len(points) + 1
                n, gl, hl = (np.cumsum(np.bincount(bins[rows, f], w, minlength=size))[:-1] for w in (None, grad[rows], hess[rows]))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = -1
                c = int(np.argmax(gain))
                if gain[c] > best[0] + 1e-9:
                    best = (float(gain[c]), f, c)
        if best[1] >= 0:
            low = bins[rows, best[1]] <= best[2]
            nodes[me][0], nodes[me][1] = best[1], float(cuts[best[1]][best[2]])
            nodes[me][2] = grow(rows[low], depth + 1)
            nodes[me][3] = grow(rows[~low], depth + 1)
        return me

    grow(np.arange(len(bins)), 0)
    return tuple(np.array(c) for c in zip(*nodes, strict=True))


def _boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int, other: np.ndarray | None = None) -> tuple[list, np.ndarray]:
    """(trees, evidence of the other rows after none, one, two, ... trees)."""
    cuts = cuts_of(x)
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
    total, found = np.zeros(len(y)), []
    after = [np.zeros(0 if other is None else len(other))]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        found.append(best_tree(bins, cuts, weight * (p - y), weight * p * (1 - p)))
        total += _of_tree(found[-1], x)
        if other is not None:
            after.append(after[-1] + _of_tree(found[-1], other))
    return found, np.array(after)


def _rates(suffixes: list[str], y: np.ndarray, weight: np.ndarray) -> dict[str, tuple[float, int]]:
    totals: dict[str, list] = {}
    for s, b, w in zip(suffixes, y.tolist(), weight.tolist(), strict=True):
        t = totals.setdefault(s, [0.0, 0.0, 0])
        t[0] += b * w
        t[1] += w
        t[2] += 1
    return {k: ((b + PRIOR_ROWS * 0.5) / (n + PRIOR_ROWS), seen) for k, (b, n, seen) in totals.items()}


def train(urls: list[str], blocked: list[int]) -> Trees:
    """Both classes weigh the same, so that what the labels say nothing about is neutral. Labels of one class alone, or none at all, give that class's rate for every URL."""
    y = np.array(blocked, float)
    if len(set(blocked)) < 2:
        rate = float((y.sum() + 0.5) / (len(y) + 1))
        return Trees({}, rate, math.log(rate / (1 - rate)))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    fold = np.array([zlib.crc32(_parts(u)[1].encode()) % FOLDS for u in urls])
    suffixes = [suffix(u) for u in urls]
    x = np.zeros((len(urls), len(FEATURES)))
    for f in range(FOLDS):  # a URL's suffix is rated by the other folds
        rest = fold != f
        stats = _rates([s for s, r in zip(suffixes, rest, strict=True) if r], y[rest], weight[rest])
        x[~rest] = features([u for u, r in zip(urls, rest, strict=True) if not r], stats, 0.5)
    loss, right = np.zeros(TREES + 1), np.zeros(TREES + 1)
    for f in range(FOLDS):
        rest = fold != f
        if rest.all() or len(set(y[rest])) < 2:
            continue
        _, after = _boosted(x[rest], y[rest], weight[rest], TREES, x[~rest])
        loss += ((np.logaddexp(0, after) - y[~rest] * after) * weight[~rest]).sum(axis=1)
        right += ((after > 0) == (y[~rest] == 1)).sum(axis=1)
    best = int(np.argmin(loss))
    trees, _ = _boosted(x, y, weight, best)
    return Trees(_rates(suffixes, y, weight), 0.5, 0.0, tuple(trees), (float(right[best] / len(y)), best))


def fit(pages: DataFrame, *, url: str = "url", labels: DataFrame | None = None, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on at most sample_rows labelled URLs (url, label: 1 to block), drawn by a hash; without labels, on URLs that the rules decide, and the fixed ones.

    Null URLs and labels don't count, a URL that comes several times counts once and is to block
    if any of its labels says so; empty tables give the fixed ones alone, or nothing to learn from.
    """
    seeds = [] if labels is not None else [(u, k) for k, own in enumerate(SEEDS) for u in own]
    if labels is None:
        u = F.col(f"`{url}`")
        verdict = ruled(host(u), path(u), rules)[1]
        labels = pages.select(u.alias("url"), (verdict == "block").cast("int").alias("label")).where("label is not null")
    rows = labels.where("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(sample_rows).collect()
    rows = [(r.url, int(r.label)) for r in rows]
    return train(*map(list, zip(*rows, *seeds * max(1, len(rows) // max(4 * len(seeds), 1))))) if rows or seeds else train([], [])


def judged(pages: DataFrame, *, url: str = "url", model: Trees | None = None, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, verdict and score (null where a rule decides).

    A null URL, and one without "://", has an empty host and path, and is judged by the trees.
    Rows that are alike all stay; columns with these names are replaced, others are carried.
    """
    model = model or fit(pages, url=url, rules=rules)

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        urls = column.to_pylist()
        return pa.array(model.scores(urls) if urls else [], pa.float64())

    u = F.col(f"`{url}`")
    out = pages.withColumns({"host": host(u), "path": path(u)})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "verdict": verdict})
    out = out.withColumn("score", scores(F.when(F.col("rule").isNull(), F.coalesce(u, F.lit("")))))
    return out.withColumns({"score": F.when(F.col("rule").isNull(), F.col("score")), "verdict": F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))})


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row, as judged() has them."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
