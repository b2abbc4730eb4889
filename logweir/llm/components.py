"""Connected components of links; links and labels never leave the executors.

Each task first joins the links of its own piece, of a bounded number of them, by union-find,
which leaves a star for every component of the piece. If there is more than one piece, the stars
are joined across pieces by alternating star operations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


#: Links that a task joins by itself, about.
PIECE = 500_000


def _stars(links: DataFrame, pieces: int) -> DataFrame:
    """(a, b), a < b: for each piece of the links, every node under the smallest node of its component."""

    def run(batches):
        parent: dict = {}

        def find(x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        kind = None
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        if kind is not None:
            nodes = [x for x in parent if find(x) != x]
            for i in range(0, len(nodes), 10_000):
                part = nodes[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], kind), pa.array(part, kind)], names=["a", "b"])

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(pieces).mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, component) for every node of the links (a, b): the component's smallest node.

    Where there are several pieces, each round hangs every node's larger neighbours, then its
    smaller ones, on the smallest node that it knows, until nothing changes; the number of rounds
    grows as the logarithm of the longest path. Minima are aggregated before they are shuffled,
    and no node's neighbours are gathered in one row, so that a hub with a third of all links is
    no hot spot. Links of a node with itself and with null don't count.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    raw = store.written(links, "links")
    pieces = -(-raw.count() // piece)
    now = store.written(_stars(raw, max(pieces, 1)), "stars")
    store.drop(raw)
    if pieces <= 1:
        return _labels(now)
    state = _state(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        large = store.written(large, "large-star")
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = large.join(low, F.col("b") == F.col("u")).select("a", "u", "m")
        small = small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        after = store.written(small, "small-star")
        store.drop(now, large)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return _labels(now)


def _labels(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
