"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

A document longer than a sequence fills whole sequences of its own first; what remains is its
last piece. Within a shard the pieces are taken by falling length. Bins are ordered by their
residual; each carries a bitmap of the sources and one of the duplicate clusters that it holds.
For a piece, the search begins at the bins whose residual is just enough and goes on to larger
ones until it finds the tightest bin that holds neither the piece's cluster nor its source; if
there is none, a new bin is opened.

Shards are dealt by a hash of the piece. Their number follows from the pieces that there can be at
most, so that no key, source, cluster or long document gathers in one task; only ids and lengths
are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words

CAPACITY = 2048
#: Pieces of a shard, about.
SHARD_ROWS = 8192


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece, in the order given; sizes are from 1 to capacity.

    A null source or cluster conflicts with nothing. Of bins with the same residual the one
    opened first is taken.
    """
    number: dict = {}
    counts = {"source": 0, "cluster": 0}

    def mask(kind: str, x) -> int:
        if x is None:
            return 0
        if (kind, x) not in number:
            number[kind, x] = counts[kind]
            counts[kind] += 1
        return 1 << number[kind, x]

    rows: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by residual
    residuals: list[int] = []  # those with bins, sorted
    used_sources: list[int] = []
    used_clusters: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = mask("source", source), mask("cluster", cluster)
        found = None
        for k in range(bisect_left(residuals, size), len(residuals)):
            r = residuals[k]
            found = next((i for i, b in enumerate(rows[r]) if not (used_sources[b] & s or used_clusters[b] & c)), None)
            if found is not None:
                break
        if found is None:
            b, r = len(used_sources), capacity
            used_sources.append(s)
            used_clusters.append(c)
        else:
            b = rows[r].pop(found)
            used_sources[b] |= s
            used_clusters[b] |= c
            if not rows[r]:
                residuals.pop(k)
        bins.append(b)
        offsets.append(capacity - r)
        left = r - size
        if left:
            if not rows[left]:
                insort(residuals, left)
            insort(rows[left], b)
    return bins, offsets


def packed(docs: DataFrame, *, doc_id: str = "doc_id", length: Column | None = None, source: str | None = "source", cluster: Column | None = None, text: str = "text", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: (doc_id, piece, n_pieces, first_token, n_tokens, shard, bin, offset, bin_id).

    length defaults to the number of words, cluster to the hash of the words in their order, so
    that copies don't share a bin. Null and empty texts have no tokens and one piece of none, in
    no bin (bin, offset and bin_id are null); so has a null length. Rows that are alike are packed
    apart, being one cluster. A null source conflicts with nothing, a null id is an id like others.
    Other columns, whatever their names, are not looked at. An empty table gives an empty one.
    """
    ws = words(F.col(f"`{text}`"))
    own_length = length is not None
    length = length if own_length else F.size(ws)
    cluster = F.md5(F.array_join(ws, " ")) if cluster is None else cluster
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("length"),
        (F.col(f"`{source}`") if source else F.lit(None)).cast("string").alias("source"),
        cluster.cast("string").alias("cluster"),
    )
    pieces = F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)).cast("int")
    rows = rows.select("*", pieces.alias("n_pieces"), F.posexplode(F.sequence(F.lit(0), pieces - 1)).alias("piece", "_"))
    rows = rows.withColumn("first_token", F.col("piece") * F.lit(capacity).cast("long"))
    rows = rows.withColumn("n_tokens", F.least(F.col("length") - F.col("first_token"), F.lit(capacity).cast("long")).cast("int")).drop("_", "length")
    # a text of n bytes has (n + 1) / 2 words at most, so that no text need be split to bound the pieces
    most = F.ceil(length / capacity) if own_length else F.floor((F.octet_length(F.col(f"`{text}`")) + 1) / (2 * capacity))
    n = docs.agg(F.coalesce(F.sum(F.coalesce(most, F.lit(0)) + 1), F.lit(1))).first()[0]
    shards = max(1, -(-int(n) // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "piece"), F.lit(shards)).cast("int"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        order = pa.table({"n": table["n_tokens"], "id": table["id"].cast(pa.string()), "c": table["cluster"], "p": table["piece"], "i": range(table.num_rows)}).sort_by([("n", "descending"), ("id", "ascending"), ("c", "ascending"), ("p", "ascending")])
        table = table.take(order["i"])
        sizes = table["n_tokens"].to_pylist()
        some = sum(1 for n in sizes if n)
        bins, offsets = pack(sizes[:some], table["source"].to_pylist()[:some], table["cluster"].to_pylist()[:some], capacity)
        none = [None] * (table.num_rows - some)
        out = table.select(["id", "piece", "n_pieces", "first_token", "n_tokens", "shard"])
        return out.append_column("bin", pa.array(bins + none, pa.int32())).append_column("offset", pa.array(offsets + none, pa.int32()))

    done = rows.groupBy("shard").applyInArrow(run, f"id {kind}, piece int, n_pieces int, first_token long, n_tokens int, shard int, bin int, offset int")
    return done.withColumn("bin_id", F.concat_ws("-", "shard", F.col("bin").cast("string"))).withColumn("bin_id", F.when(F.col("bin").isNotNull(), F.col("bin_id"))).withColumnRenamed("id", doc_id)
