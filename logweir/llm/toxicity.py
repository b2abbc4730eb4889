"""Toxicity by weak supervision.

Voters, most of them lexicons and some of them patterns, vote on a bounded sample of texts, of
which most have no label. A generative label model, fitted by expectation maximisation on the
votes alone, estimates how often each voter is right on either class; voters that go together
within a class are found by their correlation and count for less. The texts' posterior labels
choose the terms of a linear classifier over densities and are what it learns; that alone scores
the corpus.

Annotators' labels are no voter. They say which terms (words, and word beginnings of 4 to 8
bytes) make up the lexicons beside a few fixed words, from which density on a lexicon speaks, and
how often a voter was right on them, which the label model begins with and weighs as so many
texts more. Nothing of a label, language, source or id enters a score.

Texts stay on the executors: the driver gets sums by term, votes, and the chosen terms'
densities, all bounded by the number of sampled rows and not by their lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .shingles import _BASE, _LETTER, _powers, chunks, mix

#: Texts with a label, and texts without, that voters, label model and classifier are fitted on, at most.
GOLD_ROWS, PLAIN_ROWS = 4000, 8000
#: Terms of the classifier, and of the lexicon of each kind.
TERMS, LEXICON = 512, 40
#: A term of a lexicon is in toxic texts at least this much of the time, both classes weighing the same.
SURE = 0.8
#: So many texts that aren't toxic, none of which holds a fixed word, are taken for granted.
SEED_TEXTS = 200
#: What a fixed word in a hundred weighs before anything is learnt.
SEED_WEIGHT = 6.0
THRESHOLD = 0.7
BUCKETS = 1 << 20
KINDS = (0, 4, 5, 6, 7, 8)  # whole words, and beginnings of so many bytes
#: Amounts of terms are summed as integers, so that sums don't depend on their order.
UNIT = 1 << 16

# Seeds of the lexicon voters, by language.
SEEDS = (
    ("idiot", "idiots", "moron", "stupid", "scum", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown", "dumb", "shut", "hate", "garbage", "vermin", "filth"),
    ("dumm", "idioten", "abschaum", "widerlich", "trottel", "imbécile", "crétin", "ordure", "dégoûtant", "basura", "imbécil", "estúpido", "asqueroso", "escoria"),
)
PATTERNS = ("shouting", "capitals", "marks", "masked")


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    #: (name, share of right votes on toxic texts, on others, weight after correlation) of each voter.
    voters: tuple = ()


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind the bucket of every word's term, 0 if the word is shorter; and the texts' bounds."""
    letters = _LETTER[data]
    at = np.flatnonzero(letters)
    if not len(at):
        return [np.zeros(0, np.int64) for _ in KINDS], np.zeros(len(offsets), np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.searchsorted(at, offsets[:-1])
    first[starts[starts < len(at)]] = True
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, length)
    value = letters[at].astype(np.uint64) * _powers(_BASE, int(length.max()))[place]
    running = np.append(np.uint64(0), np.cumsum(value))
    out = []
    for n in KINDS:
        end = begin + (np.minimum(length, n) if n else length)
        bucket = (mix(running[end] - running[begin] + np.uint64(n * 0x9E37)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        out.append(np.where(length >= n, bucket, 0) if n else bucket)
    return out, np.searchsorted(at[begin], offsets)


def _seeds() -> list[np.ndarray]:
    """The buckets of each seed lexicon."""
    found = []
    for words in SEEDS:
        found.append(np.unique(np.concatenate([terms[0] for _, data, offsets in chunks(pa.array(words)) for terms, _ in [_terms(data, offsets)]])))
    return found


def _patterns(text: str) -> tuple[bool, ...]:
    """Votes of the pattern voters for toxic: shouting, many capitals, many exclamation or question marks, masked words."""
    n = max(len(text), 1)
    caps = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return ("!!" in text, caps > 0.3 * n, text.count("!") + text.count("?") > 0.02 * n, "**" in text or "#$" in text)


def term_sums(rows: DataFrame) -> DataFrame:
    """(bucket, kind, toxic, other) of rows (text, toxic): how much of the term texts have, shared out by how toxic they are.

    A text counts in full from one occurrence of a term in 60 words on.
    """

    def run(batches):
        sums, kind = np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, np.int8)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for row, data, offsets in chunks(batch.column("text")):
                terms, bounds = _terms(data, offsets)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                for k, t in enumerate(terms):
                    key, count = np.unique(text[t > 0] * BUCKETS + t[t > 0], return_counts=True)
                    who, bucket = key // BUCKETS, key % BUCKETS
                    amount = np.minimum(count * 60 / np.maximum(n[who], 1), 1.0) * UNIT
                    share = toxic[row + who]
                    np.add.at(sums[0], bucket, (amount * share).astype(np.int64))
                    np.add.at(sums[1], bucket, (amount * (1 - share)).astype(np.int64))
                    kind[bucket] = k
        at = np.flatnonzero(sums.any(axis=0))
        for i in range(0, len(at), 50_000):
            b = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(kind[b]), pa.array(sums[0][b]), pa.array(sums[1][b])], names=["bucket", "kind", "toxic", "other"])

    found = rows.mapInArrow(run, "bucket int, kind tinyint, toxic long, other long")
    return found.groupBy("bucket").agg(F.max("kind").alias("kind"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _differing(sums: DataFrame, n_toxic: float, n_other: float) -> DataFrame:
    """Adds z to the sums: how far the texts of either class differ in having the term."""
    n1, n0 = max(n_toxic, 1.0), max(n_other, 1.0)
    a, b = F.col("toxic") / F.lit(UNIT * n1), F.col("other") / F.lit(UNIT * n0)
    z = (a - b) / F.sqrt((a + b + F.lit(1.0 / n1)) / F.lit(n1))
    rare = F.col("toxic") < F.lit(min(2.0, n1 / 4) * UNIT)
    return sums.withColumn("z", F.when(rare, F.least(z, F.lit(0.0))).otherwise(z))


def _lexicons(sums: DataFrame, n_toxic: int, n_other: int) -> tuple[list[np.ndarray], list[str]]:
    """The seeds, and a lexicon for each kind of term: those that say most for toxic, of which four fifths or more are in toxic texts if both classes are equally large."""
    a, b = F.col("toxic") / F.lit(UNIT * n_toxic), F.col("other") / F.lit(UNIT * n_other)
    sure = (a >= F.lit(2.0 / n_toxic)) & (a > (a + b + F.lit(0.5 / n_toxic)) * F.lit(SURE))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("z"), "bucket"))
    best = sums.where(sure).withColumn("rank", rank).where(F.col("rank") <= LEXICON).select("kind", "bucket").collect()
    found = [np.array(sorted(r.bucket for r in best if r.kind == k), np.int64) for k in range(len(KINDS))]
    return _seeds() + found, ["seeds 1", "seeds 2", *(f"beginnings of {n}" if n else "words" for n in KINDS)]


def _voted(rows: DataFrame, groups: list[np.ndarray]) -> pa.Table:
    """(id, gold, densities of the groups' terms in a hundred words, patterns) of each row."""

    def run(batches):
        of = np.zeros(BUCKETS, np.uint32)
        for g, buckets in enumerate(groups):
            of[buckets] |= np.uint32(1 << g)
        for batch in batches:
            dense = np.zeros((batch.num_rows, len(groups)))
            for row, data, offsets in chunks(batch.column("text")):
                terms, bounds = _terms(data, offsets)
                n = np.diff(bounds)
                for g in range(len(groups)):
                    total = np.append(0, np.cumsum(sum((of[t] >> np.uint32(g)) & np.uint32(1) for t in terms)))
                    dense[row : row + len(n), g] = (total[bounds[1:]] - total[bounds[:-1]]) * 100 / np.maximum(n, 1)
            shouts = [list(_patterns(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("gold"), pa.array(dense.tolist(), pa.list_(pa.float64())), pa.array(shouts, pa.list_(pa.bool_()))], names=["id", "gold", "dense", "shouts"])

    return rows.select("id", "gold", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, gold double, dense array<double>, shouts array<boolean>").orderBy(F.xxhash64("id"), "id").toArrow()


def _matrix(rows: DataFrame, chosen: np.ndarray) -> np.ndarray:
    """Occurrences of each chosen term in a hundred words, by row in the order of _voted."""

    def run(batches):
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            out = np.zeros((batch.num_rows, len(chosen)), np.float32)
            for row, data, offsets in chunks(batch.column("text")):
                terms, bounds = _terms(data, offsets)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                for t in terms:
                    col = place[t]
                    on = col >= 0
                    np.add.at(out, (row + text[on], col[on]), 1)
                out[row : row + len(n)] *= (100 / np.maximum(n, 1))[:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in out], pa.binary())], names=["id", "x"])

    found = rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x binary").orderBy(F.xxhash64("id"), "id").toArrow()
    return np.concatenate([np.zeros((0, len(chosen)), np.float32), *(np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(len(c), -1) for c in found["x"].chunks if len(c))])


def label_model(votes: np.ndarray, prior: float, right: np.ndarray, texts: np.ndarray | float = 4.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 by votes in {1, -1, 0: silent}; (posterior, shares of right votes as (2, voters), weights).

    right: first guesses of the shares of right votes on class 0 and 1, which go on counting as so
    many texts of the class, as does the prior. Every two rounds the correlation of voters within the classes is
    estimated anew, and a voter's evidence is divided by one plus the sum of its positive
    correlations with the others.
    """
    speaks, yes = votes != 0, votes == 1
    first, right, before = right, right.copy(), prior
    texts = np.broadcast_to(texts, 2)
    weight = np.ones(votes.shape[1])
    post = np.full(len(votes), prior)
    for r in range(rounds):
        for_one = np.where(yes, np.log(right[1]), np.log1p(-right[1])) - np.where(yes, np.log1p(-right[0]), np.log(right[0]))
        logit = np.log(prior / (1 - prior)) + (np.where(speaks, for_one, 0.0) * weight).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        prior = float(np.clip((post.sum() + before * texts.sum()) / (len(post) + texts.sum()), 1e-3, 0.6))
        for c, p in ((0, 1 - post), (1, post)):
            total = p @ speaks
            good = p @ (speaks & (yes == bool(c)))
            right[c] = np.clip((good + texts[c] * first[c]) / (total + texts[c]), 0.02, 0.995)
        if r % 2:
            cov = np.zeros((votes.shape[1],) * 2)
            for p in (1 - post, post):
                x = np.where(speaks, votes, 0) - (p @ np.where(speaks, votes, 0)) / max(p.sum(), 1e-9)
                cov += (x * p[:, None]).T @ x
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.clip(cov / sd / sd[:, None], 0, 1)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + corr.sum(axis=1))
    return post, right, weight


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 25, centre: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton's method, weights being drawn to the centre. Rows are taken in blocks, in double precision."""
    n = x.shape[1] + 1
    middle = np.append(np.broadcast_to(centre, n - 1), 0.0)
    w = middle.copy()
    cost = np.full(n, penalty)
    cost[-1] = 1e-6

    def blocks():
        for i in range(0, len(x), 1024):
            yield np.concatenate([x[i : i + 1024], np.ones((len(x[i : i + 1024]), 1))], axis=1, dtype=np.float64), target[i : i + 1024]

    def loss(w: np.ndarray) -> float:
        return float(sum((np.logaddexp(0, z) - t * z).sum() for z, t in ((b @ w, t) for b, t in blocks())) + 0.5 * (cost * (w - middle) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        second, slope = np.diag(cost), cost * (w - middle)
        for b, t in blocks():
            p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
            second = second + (b * (p * (1 - p) + 1e-6)[:, None]).T @ b
            slope = slope + b.T @ (p - t)
        step = np.linalg.solve(second, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        before, w = now, w - size * step
        now = loss(w)
        if before - now < 1e-6 * abs(before):
            break
    return w[:-1], float(w[-1])


def voter_guesses(dense: np.ndarray, shouts: np.ndarray, gold: np.ndarray, sure: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(votes of all rows in {1, -1}, shares of right votes on gold as (2, voters)).

    Where a lexicon's density begins to speak is chosen on gold (1, 0; nan: none). The first few
    lexicons are fixed words that hardly occur in other texts, which counts as much as SEED_TEXTS of these.
    """
    n = dense.shape[1]
    votes = np.zeros((len(dense), n + shouts.shape[1]), np.int8)
    for g in range(n):
        d = dense[:, g]
        seen = d[~np.isnan(gold) & (d > 0)]
        cuts = np.unique(np.quantile(seen, np.linspace(0, 0.95, 40))) if len(seen) else np.array([1.0])
        rate = [(d[gold == 1] >= c).mean() + (d[gold == 0] < c).mean() for c in cuts]
        votes[:, g] = np.where(d >= cuts[int(np.argmax(rate))], 1, -1)
    votes[:, n:] = np.where(shouts, 1, -1)
    right = np.stack([(votes[gold == c] == s).sum(axis=0) for c, s in ((0, -1), (1, 1))]) + 1.0
    total = np.array([[(gold == 0).sum()], [(gold == 1).sum()]]) + np.full(right.shape, 2.0)
    right[0, :sure] += SEED_TEXTS
    total[0, :sure] += SEED_TEXTS
    return votes, np.clip(right / total, 0.02, 0.995)


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, gold_rows: int, plain_rows: int) -> DataFrame:
    """(id, text, gold) of up to gold_rows labelled and plain_rows unlabelled ids outside the held-out fold, drawn by a hash of the id."""
    drawn = lambda df, n: df.orderBy(F.xxhash64("id"), "id").limit(n)
    own = F.col(f"`{doc_id}`").alias("id")
    known = labels.where(F.col(f"`{label}`").isNotNull()).select(own, F.col(f"`{label}`").cast("double").alias("gold")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.avg("gold").alias("gold"))
    ids = docs.select(own).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    gold = drawn(ids.join(known, "id"), gold_rows)
    plain = drawn(ids.join(known, "id", "left_anti"), plain_rows).withColumn("gold", F.lit(None).cast("double"))
    wanted = store.written(gold.unionByName(plain), "drawn-ids")
    rows = docs.select(own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")
    one = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("gold").alias("gold"))  # an id that comes several times counts once
    return store.written(one.repartition(max(4, docs.sparkSession.sparkContext.defaultParallelism)), "sample")


def held_out(doc_id: Column) -> Column:
    """The fold whose labels nothing is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", gold_rows: int = GOLD_ROWS, plain_rows: int = PLAIN_ROWS) -> Model:
    """Fits on at most gold_rows labelled and plain_rows unlabelled texts outside the held-out fold, drawn by a hash of the id.

    Ids with several labels count by their mean; null labels and ids don't count; of several texts
    of one id the least counts; null texts are empty. Without both labels, or on empty tables,
    the fixed words alone decide. Other columns, whatever their names, are not looked at.
    """
    with store.passing():
        return _fitted(_sample(docs, labels, doc_id, text, label, gold_rows, plain_rows))


def _fitted(sample: DataFrame) -> Model:
    hard = (F.col("gold") >= 0.5).cast("double")
    n1, n0 = sample.agg(F.count_if(hard == 1), F.count_if(hard == 0)).first()
    if not n1 or not n0:
        chosen = np.unique(np.concatenate(_seeds()))
        return Model(chosen, np.full(len(chosen), SEED_WEIGHT, np.float32), -4.0)
    sums = term_sums(sample.where("gold is not null").select("text", hard.alias("toxic")))
    groups, names = _lexicons(_differing(sums, n1, n0), n1, n0)
    table = _voted(sample, groups)
    gold = table["gold"].to_numpy().astype(float)
    gold = np.where(np.isnan(gold), np.nan, gold >= 0.5)
    dense = np.array(table["dense"].to_pylist(), float)
    votes, guess = voter_guesses(dense, np.array(table["shouts"].to_pylist(), bool), gold, len(SEEDS))
    post, right, weight = label_model(votes, n1 / (n1 + n0), guess, np.array([n0, n1], float))
    # the posteriors choose the classifier's terms
    ids = sample.sparkSession.createDataFrame(pa.table({"id": table["id"], "toxic": pa.array(post)}))
    sums = term_sums(sample.select("id", "text").join(F.broadcast(ids), "id").select("text", "toxic"))
    best = _differing(sums, float(post.sum()), float((1 - post).sum())).where(F.abs("z") > 1.2).orderBy(F.desc(F.abs("z")), "bucket").limit(TERMS).select("bucket").collect()
    terms = np.unique(np.concatenate([np.array([r.bucket for r in best], np.int64), *_seeds()]))
    x = _matrix(sample, terms)
    weights, bias = fit_linear(x, post, centre=np.where(np.isin(terms, np.concatenate(_seeds())), SEED_WEIGHT, 0.0))
    report = tuple(zip([*names, *PATTERNS], right[1].round(4).tolist(), right[0].round(4).tolist(), weight.round(4).tolist(), strict=True))
    return Model(terms, weights.astype(np.float32), bias, report)


def score(text: Column, model: Model) -> Column:
    """The classifier's probability; null and empty texts get that of a text without any term."""
    buckets, weights, bias = model.buckets, model.weights, model.bias
    table: list[np.ndarray] = []

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if not table:
            weight = np.zeros(BUCKETS, np.float32)
            weight[buckets] = weights
            table.append(weight)
        out = np.zeros(len(column))
        for row, data, offsets in chunks(column):
            terms, bounds = _terms(data, offsets)
            total = np.append(0.0, np.cumsum(sum(table[0][t].astype(np.float64) for t in terms)))
            n = np.diff(bounds)
            x = bias + (total[bounds[1:]] - total[bounds[:-1]]) * 100 / np.maximum(n, 1)
            out[row : row + len(n)] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return pa.array(out)

    return scored(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Rows that are alike all stay; a null id is held out by none."""
    model = fit(docs, labels, **options)
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns.

    Null and empty texts have the score of a text without any term, which stays below it unless
    nearly all labels are toxic; rows that are alike stay or go together; null ids count like
    others; an empty table gives an empty one.
    """
    return docs.where(score(F.col(f"`{text}`"), fit(docs, labels, text=text, **options)) < THRESHOLD)
