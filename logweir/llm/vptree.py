"""Nearest neighbours by inner product, in vantage-point trees over shards.

Vectors are extended by one component that brings all to the length of the longest, queries by
a zero: then the largest inner product is the smallest Euclidean distance, and the triangle
inequality holds. A bounded number of vectors, drawn by a hash, are the vantage points of cells:
each distinct vector belongs to the nearest, and a cell that is larger than a shard is cut into
several. Each shard gets one tree over its vectors; a node has a vantage point, and for either
side the least and largest distance to it and the least length.

A query first goes to the cells that are nearest to it, as many as hold enough vectors; what it
finds there is a bound, with which it then goes to those of the other cells that can hold something
nearer by the triangle inequality. In a shard's task the vectors come first, of which the tree is
built, and the queries after them, in batches: every vector is shuffled to its shard once in a
round, however many queries there are, and a task holds one shard and one batch.

A side of a node or a cell is skipped if the largest inner product that the triangle inequality
admits there lies below the worst of the nearest found so far: with factor one the search is exact,
ties included. Larger factors skip more, as if all distances were between vectors of the side's
least length, so that how much more does not depend on the longest vector, nor on the query's
length. Whatever may tie with the worst is scored on the original vectors, in double precision, and
the smaller id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

NEAREST = 20
#: Vectors of a shard, cells at most, vectors of a leaf, queries that go through a tree together.
SHARD_ROWS, CELLS, LEAF, BATCH_ROWS = 8192, 4096, 128, 2048
FACTOR = 1.1


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed in the same order whatever the number of rows, so that equal vectors score equally."""
    return np.concatenate([(x[i : i + 65536] * y[i : i + 65536]).sum(axis=1) for i in range(0, len(x), 65536)] or [np.zeros(0)])


class Tree:
    """A vantage-point tree over the rows of x, whose names decide ties; seeded, and so the same for the same rows."""

    def __init__(self, x: np.ndarray, limit: float, leaf: int = LEAF, names: np.ndarray | None = None):
        self.x, self.limit, self.leaf = x, limit, leaf
        self.names = np.arange(len(x)) if names is None else names
        self.norms = np.einsum("ij,ij->i", x, x)
        self.rest = np.sqrt(np.maximum(limit - self.norms, 0.0))
        self.rng = np.random.default_rng(7)
        self.root = self._build(np.arange(len(x)))

    def _apart(self, rows: np.ndarray, v: int) -> np.ndarray:
        """Distances in the extended space."""
        apart = self.x[rows] - self.x[v]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart) + (self.rest[rows] - self.rest[v]) ** 2)

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        v = int(rows[self.rng.integers(len(rows))])
        d = self._apart(rows, v)
        middle = np.median(d)
        near = d <= middle
        if near.all():
            near = d < middle
            if not near.any():
                return rows
        sides = [(float(d[m].min()), float(d[m].max()), float(np.sqrt(self.norms[rows[m]].min())), self._build(rows[m])) for m in (near, ~near)]
        return v, sides

    def search(self, q: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inner products, rows) of the k nearest to each query, nearest first, ties by name; row -1 where there are fewer.

        What lies below a query's bound need not be found.
        """
        best = np.full((len(q), k), -np.inf)
        rows = np.full((len(q), k), -1)
        names = np.full((len(q), k), np.iinfo(np.int64).max)
        floor = np.full(len(q), -np.inf) if bound is None else bound
        square = np.einsum("ij,ij->i", q, q)
        length, slack = np.sqrt(square), 1e-12 * (square + self.limit)

        def visit(node, who: np.ndarray):
            if isinstance(node, np.ndarray):
                self._leaf(node, who, q, best, rows, names, np.maximum(best[who, -1], floor[who]) - slack[who])
                return
            v, sides = node
            d = np.sqrt(np.maximum(square[who] + self.limit - 2 * (q[who] @ self.x[v]), 0.0))
            bounds = [np.maximum(np.maximum(low - d, d - high), 0.0) for low, high, _, _ in sides]
            first = bounds[0] <= bounds[1]
            near = np.where(bounds[0] == bounds[1], d <= (sides[0][1] + sides[1][0]) / 2, first)
            for own, order in ((near, (0, 1)), (~near, (1, 0))):
                if own.any():
                    for side in order:
                        at = who[own]
                        stay = admits(square[at], length[at], self.limit, bounds[side][own], sides[side][2], factor) + slack[at] >= np.maximum(best[at, -1], floor[at])
                        if stay.any():
                            visit(sides[side][3], at[stay])

        if len(self.x) and len(q):
            visit(self.root, np.arange(len(q)))
        return best, rows

    def _leaf(self, node, who, q, best, rows, names, least) -> None:
        """Holds the queries against a leaf; only what may be among the nearest is scored exactly."""
        i, j = np.nonzero(q[who] @ self.x[node].T >= least[:, None])
        if not len(i):
            return
        use, place = np.unique(i, return_inverse=True)
        score = np.full((len(use), len(node)), -np.inf)
        score[place, j] = _inner(q[who[i]], self.x[node[j]])
        name = np.full(score.shape, np.iinfo(np.int64).max)
        name[place, j] = self.names[node[j]]
        at, k = who[use], best.shape[1]
        score, name = np.concatenate([best[at], score], axis=1), np.concatenate([names[at], name], axis=1)
        row = np.concatenate([rows[at], np.broadcast_to(node, (len(use), len(node)))], axis=1)
        order = np.lexsort((name, -score), axis=1)[:, :k]
        best[at], names[at], rows[at] = (np.take_along_axis(c, order, axis=1) for c in (score, name, row))
        rows[at] = np.where(np.isneginf(best[at]), -1, rows[at])


def admits(square, length, limit, apart, least_length, factor):
    """The largest inner product that a query may have with vectors this far apart from it at least; a larger factor admits less."""
    most = (square + limit - apart**2) / 2
    return most - (factor**2 - 1) * np.maximum(length * least_length - most, 0.0)


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Cells:
    """Vantage points of the cells of vectors of one size, and what is known of each cell."""

    def __init__(self, pivots: np.ndarray, limit: float):
        self.pivots, self.limit = pivots, limit
        self.norms = np.einsum("ij,ij->i", pivots, pivots)
        self.rest = np.sqrt(np.maximum(limit - self.norms, 0.0))
        n = len(pivots)
        self.count, self.low, self.high, self.least = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf), np.zeros(n)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its vantage point) of each vector."""
        norms = np.einsum("ij,ij->i", x, x)
        rest = np.sqrt(np.maximum(self.limit - norms, 0.0))
        cell = np.argmin(self.norms + self.rest**2 - 2 * (x @ self.pivots.T + rest[:, None] * self.rest), axis=1)
        apart = x - self.pivots[cell]
        return cell, np.sqrt(np.einsum("ij,ij->i", apart, apart) + (rest - self.rest[cell]) ** 2)

    def admitted(self, q: np.ndarray, factor: float) -> np.ndarray:
        """The largest inner product that each query may have in each cell; none in empty cells."""
        square = np.einsum("ij,ij->i", q, q)
        d = np.sqrt(np.maximum(square[:, None] + self.limit - 2 * (q @ self.pivots.T), 0.0))
        slack = 1e-9 * np.sqrt(square + self.limit)[:, None]
        apart = np.maximum(np.maximum(self.low - d, d - self.high) - slack, 0.0)
        most = admits(square[:, None], np.sqrt(square)[:, None], self.limit, apart, self.least, factor)
        return np.where(self.count > 0, most + 1e-12 * (square[:, None] + self.limit), -np.inf)


def _dealt(points: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(size, cell, apart, length, x, ids) of (x, ids)."""

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            cell, apart, length = np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size))
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                x = _vectors(batch.column("x").take(pa.array(own)))
                for i in range(0, len(own), 1024):
                    cell[own[i : i + 1024]], apart[own[i : i + 1024]] = cells[s].nearest(x[i : i + 1024])
                length[own] = np.sqrt(np.einsum("ij,ij->i", x, x))
            yield pa.RecordBatch.from_arrays([batch.column("size"), pa.array(cell.astype(np.int32)), pa.array(apart), pa.array(length), batch.column("x"), batch.column("ids")], names=["size", "cell", "apart", "length", "x", "ids"])

    return points.mapInArrow(run, "size int, cell int, apart double, length double, x array<double>, ids array<bigint>")


def _asked(queries: DataFrame, cells: dict[int, Cells], k: int, factor: float, first: bool) -> DataFrame:
    """(size, cell, qid, x, bound) for each query (size, qid, x, bound) and each cell that it goes to: first the nearest ones that together hold k vectors, then the others that its bound admits."""

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                for i in range(0, len(own), 256):
                    part = own[i : i + 256]
                    c = cells[s]
                    most = c.admitted(_vectors(batch.column("x").take(pa.array(part))), factor)
                    order = np.argsort(-most, axis=1, kind="stable")
                    held = np.cumsum(c.count[order], axis=1) - c.count[order]
                    near = np.zeros(most.shape, bool)
                    np.put_along_axis(near, order, held < k, axis=1)
                    who, cell = np.nonzero((near if first else ~near & (most >= bound[part][:, None])) & (c.count > 0))
                    at = pa.array(part[who])
                    yield pa.RecordBatch.from_arrays([batch.column("size").take(at), pa.array(cell.astype(np.int32)), batch.column("qid").take(at), batch.column("x").take(at), batch.column("bound").take(at)], names=["size", "cell", "qid", "x", "bound"])

    return queries.select("size", "qid", "x", "bound").mapInArrow(run, "size int, cell int, qid long, x array<double>, bound double")


def _searched(points: DataFrame, asked: DataFrame, limit: float, k: int, factor: float, partitions: int) -> DataFrame:
    """(qid, vec_id, score): for each query (size, cell, shard, qid, x, bound) the k nearest ids of the shard (size, cell, shard, x, ids)."""
    rows = points.select("size", "cell", "shard", F.lit(0).alias("asks"), F.lit(0).cast("long").alias("qid"), "x", "ids", F.lit(0.0).alias("bound"))
    rows = rows.unionByName(asked.select("size", "cell", "shard", F.lit(1).alias("asks"), "qid", "x", F.lit(None).cast("array<bigint>").alias("ids"), "bound"))
    rows = rows.repartition(partitions, "size", "cell", "shard").sortWithinPartitions("size", "cell", "shard", "asks")

    def answers(tree: Tree, ids: list, qid: np.ndarray, q: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        scores, found = tree.search(q, k, factor, bound)
        who, name, score = [], [], []
        for i in range(len(q)):
            n = int((found[i] >= 0).sum())
            own = [ids[p] for p in found[i][:n].tolist()]
            each = np.concatenate(own) if own else np.zeros(0, np.int64)
            value = np.repeat(scores[i][:n], [len(m) for m in own])
            top = np.lexsort((each, -value))[:k]
            who.append(np.full(len(top), qid[i]))
            name.append(each[top])
            score.append(value[top])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (who, name, score)], names=["qid", "vec_id", "score"])

    def run(batches):
        now, tree, parts, ids = None, None, [], []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("size", "cell", "shard", "asks")], axis=1)
            edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=True):
                shard, asks = tuple(key[a, :3].tolist()), key[a, 3]
                if shard != now:
                    now, tree, parts, ids = shard, None, [], []
                own = batch.slice(a, b - a)
                if not asks:
                    parts.append(_vectors(own.column("x")))
                    lists = own.column("ids")
                    at = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                    flat = lists.flatten().to_numpy()
                    ids += [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    continue
                if not parts:
                    continue
                if tree is None:
                    x = np.concatenate(parts)
                    order = np.lexsort(x.T[::-1])  # the same tree whatever the order of rows
                    parts, ids = [x[order]], [ids[i] for i in order.tolist()]
                    tree = Tree(parts[0], limit, names=np.array([m[0] for m in ids]))
                qid, q, bound = own.column("qid").to_numpy(), _vectors(own.column("x")), own.column("bound").to_numpy(zero_copy_only=False)
                for i in range(0, len(q), BATCH_ROWS):
                    yield from answers(tree, ids, qid[i : i + BATCH_ROWS], q[i : i + BATCH_ROWS], bound[i : i + BATCH_ROWS])

    return rows.mapInArrow(run, "qid long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which queries holds.

    Candidates are all rows with another id and as many components; ties go to the smaller id;
    where there are fewer than k, all. Vectors that aren't valid() take no part. Rows that are
    alike stay candidates each; of queries that are alike one is answered. Many copies of one
    vector are one point of a tree, of which the k + 1 smallest ids are kept. Only the columns
    named are looked at, whatever others there are; an empty table gives an empty one.
    """
    v = F.col("v")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"), queries.alias("query")).where(valid(v) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", "query", F.transform(v, lambda c: c.cast("double") + F.lit(0.0)).alias("x")).withColumn("h", F.xxhash64("x"))
    # copies of a vector become one point; a common one's are cut to the few smallest ids before the shuffle. Hashes are sorted by before vectors are
    first = Window.partitionBy("h", "x").orderBy("vec_id")
    few = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    with store.passing():
        points = store.written(few.groupBy("h", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.size("x").alias("size"), "x", "ids"), "points")
        found = _nearest(points, rows.where("query").select("vec_id", "h", "x"), k, factor, shard_rows, cells)
        found = store.kept(store.written(found, "nearest"))
    return found


def _nearest(points: DataFrame, asking: DataFrame, k: int, factor: float, shard_rows: int, most_cells: int) -> DataFrame:
    spark = points.sparkSession
    sizes = points.groupBy("size").agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).collect()  # a row for each number of components
    longest = max((r.longest for r in sizes), default=0.0) * (1 + 1e-9)
    at: dict[int, Cells] = {}
    for r in sizes:
        n = min(max(1, -(-r.n // shard_rows)), most_cells)
        drawn = points.where(F.col("size") == r.size).orderBy(F.xxhash64("x"), "x").limit(n).select("x").toArrow()
        at[r.size] = Cells(_vectors(drawn["x"]), longest)
    dealt = store.written(_dealt(points, at), "dealt")
    known = dealt.groupBy("size", "cell").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high"), F.min("length").alias("least")).collect()  # at most as many as cells
    for r in known:
        c = at[r.size]
        c.count[r.cell], c.low[r.cell], c.high[r.cell], c.least[r.cell] = r.n, r.low, r.high, r.least
    shards = spark.createDataFrame([(r.size, r.cell, -(-r.n // shard_rows)) for r in known], "size int, cell int, shards int")
    shards = F.broadcast(shards)  # a row for each cell
    sharded = dealt.join(shards, ["size", "cell"]).select("size", "cell", F.pmod(F.xxhash64("x"), F.col("shards")).cast("int").alias("shard"), "x", "ids")
    every = lambda df: df.join(shards, ["size", "cell"]).select("size", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "qid", "x", "bound")
    partitions = max(1, sum(-(-r.n // shard_rows) for r in known))
    keep = k + 1  # one of them may be the query itself
    distinct = asking.groupBy("h", "x").agg(F.lit(0).alias("_")).select(F.size("x").alias("size"), "h", "x", F.monotonically_increasing_id().alias("qid"))
    distinct = store.written(distinct, "queries")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    near = store.written(top(_searched(sharded, every(_asked(distinct.withColumn("bound", F.lit(float("-inf"))), at, keep, factor, True)), longest, keep, factor, partitions)), "first-round")
    bounds = near.where(F.col("place") == keep).select("qid", F.col("score").alias("bound"))
    again = distinct.join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    far = _searched(sharded, every(_asked(again, at, keep, factor, False)), longest, keep, factor, partitions)
    both = store.written(top(near.drop("place").unionByName(far)).drop("place"), "second-round")
    asked = asking.select(F.col("vec_id").alias("query_id"), "h", "x").distinct().join(distinct.select("h", "x", "qid"), ["h", "x"]).select("query_id", "qid")
    own = asked.join(both, "qid").where(F.col("vec_id") != F.col("query_id"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame, **options) -> DataFrame:
    """The search for the rows whose vec_id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0, **options)
