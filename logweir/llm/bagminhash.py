"""Near duplicates by weighted MinHash (BagMinHash), bands, and exact verification.

A text is the multiset of its word shingles. A shingle's weights are cut into the intervals
(0, 1], (1, 2], (2, 4], (4, 8], ...; on each interval runs a Poisson process whose rate is the
interval's width. Each of its points has a time, a slot of the signature and a weight in the
interval, all drawn from the shingle's hash, and counts for the texts whose weight of the
shingle reaches the point's. A slot holds the text's first point there: two texts agree in a
slot with the probability of their weighted Jaccard similarity. Points are drawn in the order
of time and only up to the time at which all slots are filled, so that most shingles cost one
draw, and a weight of 1000 costs ten processes at most.

ROWS slots make a band. Texts that share a band are a bucket. In every bucket one member leads,
and the others are held against it, on the whole texts, unless their weights alone rule it out.
Where a bucket then has members outside its largest component, they are held against a few
more of that component. Those that are still outside are then held against all members of other
components: pair by pair in a small bucket; in a large one by tiles, of which every two that can
hold a link are crossed in one task, by products of matrices, and only links are emitted. Buckets
lead in several orders, and near duplicates share seven of them on average, so that a member is
held against many leaders before, and only open buckets go on.

So every two texts that share a band are in one component or were held against each other, and a
link is missed only if its texts share no band, which happens to one in 5,000 at a similarity of
0.8 and to fewer above, and if they are joined by no other links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .components import components
from .shingles import mix, of_column, overlap

SHINGLE, LEAST = 5, 0.8
ROWS, BANDS = 6, 28
#: Leaders of a bucket in its second round; members of a small one; orders in which members lead.
LEADERS, SMALL, ORDERS = 4, 32, 7
#: Texts and, about, shingles of a tile; elements that are multiplied at a time.
TILE_ROWS, TILE_SHINGLES, STRIP = 1024, 300_000, 2048
#: Up to so many keys are broadcast to pick texts; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(shingles: np.ndarray, counts: np.ndarray, bounds: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their signatures as an array of 64-bit point names)."""
    sizes = np.diff(bounds)
    texts = np.flatnonzero(sizes)
    number = np.repeat(np.arange(len(texts)), sizes[texts])
    total = np.bincount(number, counts, minlength=len(texts))
    # one element for each shingle and interval
    last = np.ceil(np.log2(counts)).astype(np.int64)
    each = np.repeat(np.arange(len(counts)), last + 1)
    interval = np.arange(len(each)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)
    low = np.where(interval == 0, 0.0, 2.0 ** (interval - 1))
    width = np.maximum(low, 1.0)
    share = np.minimum((counts[each] - low) / width, 1.0)
    seed = mix(shingles[each] + interval.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    owner = number[each]
    best = np.full(len(texts) * slots, np.inf)
    name = np.zeros(len(texts) * slots, np.uint64)
    until = slots * (np.log(slots) + 2) / total
    # where each element's process stands: its last point's time
    time, draw, alive = np.zeros(len(each)), np.zeros(len(each), np.uint64), np.arange(len(each))
    while len(alive):
        parked = []
        while len(alive):
            key = mix(seed[alive] + draw[alive] * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1))
            t = time[alive] - np.log(_uniform(key)) / width[alive]
            on = t <= until[owner[alive]]
            parked.append(alive[~on])  # this draw comes again if the time is extended
            alive, t, key = alive[on], t[on], key[on]
            time[alive] = t
            draw[alive] += np.uint64(1)
            other = mix(key ^ np.uint64(0x8EBC6AF09C88C6E3))
            inside = _uniform(other) <= share[alive]
            at = owner[alive][inside] * slots + (mix(other) % np.uint64(slots)).astype(np.int64)[inside]
            t, key = t[inside], key[inside]
            before = best[at]
            less = t < before
            at, t, key = at[less], t[less], key[less]
            np.minimum.at(best, at, t)
            first = best[at] == t
            name[at[first]] = key[first]
        open_ = np.isinf(best.reshape(len(texts), slots)).any(axis=1)
        until[open_] += slots * 3 / total[open_]
        rest = np.concatenate(parked) if parked else alive
        alive = rest[open_[owner[rest]]]
    return texts, name.reshape(len(texts), slots)


def band_hashes(names: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each text and band."""
    bands = names.reshape(len(names), -1, rows)
    total = np.arange(bands.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for r in range(rows):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return total.view(np.int64)


def _with_bands(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(id, node, text) to (id, node, weight, bands); bands is null for texts without words."""

    def run(batches):
        for batch in batches:
            found = np.zeros((batch.num_rows, bands), np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            empty = np.ones(batch.num_rows, bool)
            for row, *sets in of_column(batch.column("text"), shingle):
                texts, names = signatures(*sets, rows * bands)
                _, counts, bounds = sets
                total = np.append(0, np.cumsum(counts))
                weight[row : row + len(bounds) - 1] = total[bounds[1:]] - total[bounds[:-1]]
                if len(texts):
                    found[row + texts] = band_hashes(names, rows)
                    empty[row + texts] = False
            offsets = np.append(0, np.cumsum(np.where(empty, 0, bands))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(empty, False)), pa.array(found[~empty].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array(weight), values], names=["id", "node", "weight", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, node binary, weight long, bands array<bigint>")


def _verified(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of the pairs (a, b, text_a, text_b), those of at least this similarity: (a, b, similarity)."""

    def run(batches):
        known: tuple = (None, None)  # pairs come by their leader
        for batch in batches:
            keep, values = [], []
            leaders = batch.column("a").to_pylist()
            text_a = batch.column("text_a")
            sets_b = (((h[a:b], n[a:b])) for _, h, n, bounds in of_column(batch.column("text_b"), shingle) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            for i, (leader, own) in enumerate(zip(leaders, sets_b, strict=True)):
                if known[0] != leader:
                    _, h, n, _ = next(of_column(text_a.slice(i, 1), shingle))
                    known = (leader, (h, n))
                value = overlap(known[1], own)
                if value >= least:
                    keep.append(i)
                    values.append(value)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a binary, b binary, similarity double")


def _elements(column: pa.ChunkedArray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element) of each shingle of each text, a shingle's further occurrences being elements of their own; shingles by row."""
    rows, names, weight = [], [], np.zeros(len(column), np.int64)
    for row, hashes, counts, bounds in of_column(column, shingle):
        owner = row + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        again = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        name = np.repeat(hashes, counts)
        rows.append(np.repeat(owner, counts))
        names.append(np.where(again > 0, mix(name + again.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), name))
        weight += np.bincount(rows[-1], minlength=len(column))
    return np.concatenate(rows), np.concatenate(names), weight


def _common(rows: np.ndarray, names: np.ndarray, left: np.ndarray, right: np.ndarray, kind: type) -> np.ndarray:
    """How many elements each of the left rows has in common with each of the right ones."""
    _, at, n = np.unique(names, return_inverse=True, return_counts=True)
    shared = n > 1
    column = (np.cumsum(shared) - 1)[at]
    rows, column = rows[shared[at]], column[shared[at]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(right)), kind)
    n_rows, n_columns = int(max(left.max(), right.max())) + 1, int(shared.sum())
    for low in range(0, n_columns, STRIP):
        a, b = np.searchsorted(column, (low, low + STRIP))
        strip = np.zeros((n_rows, min(STRIP, n_columns - low)), kind)
        strip[rows[a:b], column[a:b] - low] = 1
        out += strip[left] @ strip[right].T
    return out


def _crossed(own: DataFrame, nodes: DataFrame, left: DataFrame, shingle: int, least: float, broadcast_rows: int) -> DataFrame:
    """All links (a, b, similarity) between a bucket's members outside its largest component and those of other components.

    Members are graded by weight, so that links are within a grade or between two that follow
    each other, and dealt by hash to tiles of bounded size.
    """
    step = -math.log(least) + 1e-6
    grade = F.floor(F.log("weight") / step).cast("int")
    at = left.select("bucket", "node", "component", "outside", grade.alias("grade"))
    most = F.floor(F.lit(TILE_SHINGLES) / F.exp((F.col("grade") + 1) * step))
    tiles = F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), most))).cast("int")
    sizes = at.groupBy("bucket", "outside", "grade").agg(F.count("*").alias("n")).select("bucket", "outside", "grade", tiles.alias("tiles"))
    each = sizes.select("bucket", "outside", "grade", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    each = each.select("bucket", F.struct("outside", "grade", "tile").alias("t"))
    both = each.where("t.outside").join(each.select("bucket", F.col("t").alias("u")), "bucket").where((F.abs(F.col("t.grade") - F.col("u.grade")) <= 1) & (~F.col("u.outside") | (F.col("t") <= F.col("u"))))
    both = store.written(both.withColumn("cross", F.monotonically_increasing_id()), "crossings")
    sides = both.select("cross", "bucket", F.lit(0).alias("side"), "t.*").unionByName(both.where("t <> u").select("cross", "bucket", F.lit(1).alias("side"), "u.*"))
    dealt = at.join(sizes, ["bucket", "outside", "grade"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.join(sides, ["bucket", "outside", "grade", "tile"]).select("cross", "side", "node", "component")
    texts = _texts(own, nodes, left.select("node").distinct(), broadcast_rows)

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(second)  # a tile is crossed with itself, or the other one is empty
        second = first if alone else second
        out = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "similarity": pa.array([], pa.float64())})
        if not len(first):
            return out
        rows, names, weight = _elements(table["text"], shingle)
        component = table["component"].combine_chunks().dictionary_encode()
        component = (component.combine_chunks() if isinstance(component, pa.ChunkedArray) else component).indices.to_numpy()
        common = _common(rows, names, first, second, np.float32 if weight.max() < 2**24 else np.float64).astype(np.float64)
        value = common / np.maximum(weight[first][:, None] + weight[second][None, :] - common, 1)
        hit = (value >= least) & (component[first][:, None] != component[second][None, :])
        i, j = np.nonzero(np.triu(hit, 1) if alone else hit)
        if not len(i):
            return out
        a, b = table["node"].take(pa.array(first[i])), table["node"].take(pa.array(second[j]))
        return pa.table({"a": a, "b": b, "similarity": pa.array(value[i, j], pa.float64())})

    found = dealt.join(texts, "node").groupBy("cross").applyInArrow(run, "a binary, b binary, similarity double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").dropDuplicates(["a", "b"])


def _order(turn: int = 0) -> tuple[Column, Column]:
    """The order in which a bucket's members lead, one of a few: buckets with much the same members then have the same leaders."""
    return F.xxhash64(F.pmod("bucket", F.lit(ORDERS)) + F.lit(ORDERS * turn), "node").alias("order"), F.col("node")


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (node, component) after more links (a, b): only the components that these join are looked at."""
    if labels is None:
        return store.written(components(found.select("a", "b")), "components")
    named = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    ends = found.select("a", "b").join(named, "a", "left").join(named.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    ends = store.written(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "joined-links")
    more = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("n")).select("n.*").distinct()
    every = labels.unionByName(new).distinct()
    return store.written(every.join(more, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, rows: int = ROWS, bands: int = BANDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, class_id, n_verified) for each row: the class is named by its smallest doc_id.

    A class holds the rows that links of at least this weighted Jaccard similarity join, over
    any number of steps; n_verified counts those links of the row's text that were verified on the
    way, at least one in a class of several texts: texts that links have already joined are not
    held against each other, so that a text may have more links than that. Rows with the same text are one node and always of one class, null texts being
    empty; texts without words are near to nothing but their exact copies. A text of fewer words
    than a shingle is one shingle. Rows that are alike all stay; rows without an id can't name a
    class unless the class has no other. An empty table gives an empty one.
    """
    found = classes(docs, doc_id=doc_id, text=text, shingle=shingle, least=least, rows=rows, bands=bands, broadcast_rows=broadcast_rows)
    return found.select(F.col("id").alias(doc_id), "class_id", "n_verified")


def _nodes_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, node): null texts are empty, and a node is the hash of a text."""
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return own.withColumn("node", F.unhex(F.md5("text")))


def _classes(own: DataFrame, shingle: int, least: float, rows: int, bands: int, broadcast_rows: int) -> DataFrame:
    """(node, least, class_id, n_verified, leads) of each node; least is its smallest id."""
    nodes = _with_bands(own.select("id", "node", "text"), shingle, rows, bands).groupBy("node").agg(F.min("id").alias("id"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = store.written(nodes, "nodes")
    members = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    crowded = store.written(members.join(shared, "bucket"), "crowded")
    # a similarity of at least s needs weights of which the smaller is at least s times the larger
    fits = F.least("weight", "lead_weight") >= F.greatest("weight", "lead_weight") * (least - 1e-9)
    tested = links = labels = None
    for turn in range(3):
        if not turn:
            first = crowded.groupBy("bucket").agg(F.min(F.struct(*_order(), "weight")).alias("first"))
            lead = first.select("bucket", F.col("first.node").alias("a"), F.col("first.weight").alias("lead_weight"))
            pairs = crowded.join(lead, "bucket").where((F.col("a") != F.col("node")) & fits)
        else:
            at = crowded if labels is None else crowded.join(labels, "node", "left")
            at = at.select("bucket", "node", "weight", (F.col("node") if labels is None else F.coalesce("component", "node")).alias("component"))
            per = at.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("members")).where("components > 1")
            left = at.join(per.select("bucket", "members", F.col("largest.component").alias("largest")), "bucket")
            left = store.written(left.withColumn("outside", F.col("component") != F.col("largest")), "open-buckets")
            few = left.where(F.col("members") <= SMALL)
            if turn == 1:
                # one leader by each of a few orders, so that no bucket's members are ranked in one task
                firsts = [F.min(F.struct(*_order(i), "weight", "component")) for i in range(LEADERS)]
                lead = left.where("not outside").groupBy("bucket").agg(F.array(*firsts).alias("firsts")).select("bucket", F.explode(F.array_distinct("firsts")).alias("first"))
                lead = lead.select("bucket", F.col("first.node").alias("a"), F.col("first.weight").alias("lead_weight"), F.col("first.component").alias("own"))
                pairs = left.where("outside").join(lead, "bucket")
            else:
                lead = few.where("outside").select("bucket", F.col("node").alias("a"), F.col("weight").alias("lead_weight"), F.col("component").alias("own"))
                pairs = few.join(lead, "bucket")
            pairs = pairs.where((F.col("component") != F.col("own")) & fits)
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        pairs = store.written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not pairs.isEmpty():
            found = store.written(_tested(own, nodes, pairs, shingle, least, broadcast_rows), "verified")
            links = found if links is None else links.unionByName(found)
            labels = _joined(labels, found)
        large = left.where(F.col("members") > SMALL) if turn == 2 else None
        if large is not None and not large.isEmpty():
            found = store.written(_crossed(own, nodes, large, shingle, least, broadcast_rows), "crossed")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                labels = _joined(labels, found)
    if links is None:
        links = pairs.select("a", "b")  # none
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    degree = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = degree.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).unionByName(degree.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")))
    degree = ends.groupBy("node").agg(F.sum("n").cast("long").alias("n_verified"))
    named = nodes.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("id").alias("class_id"), F.min(F.struct(F.isnull("id").alias("_"), "id", "node")).alias("first"))
    found = named.join(names, "component").join(degree, "node", "left").select("node", F.col("id").alias("least"), "class_id", F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"), (F.col("node") == F.col("first.node")).alias("leads"))
    return store.kept(store.written(found, "classes"))


def classes(docs: DataFrame, *, doc_id: str, text: str, shingle: int, least: float, rows: int, bands: int, broadcast_rows: int) -> DataFrame:
    """(id, node, class_id, n_verified, keep) for each row; node is the text's hash, and keep is true for one id and text of a class."""
    own = _nodes_of(docs, doc_id, text)
    with store.passing():
        found = _classes(own, shingle, least, rows, bands, broadcast_rows)
    keep = F.col("leads") & F.col("id").eqNullSafe(F.col("least"))
    return own.select("id", "node").join(found, "node").select("id", "node", "class_id", "n_verified", keep.alias("keep"))


def _tested(own: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: float, broadcast_rows: int) -> DataFrame:
    """Fetches the texts of the pairs (a, b) and verifies them."""
    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct())
    texts = _texts(own, nodes, ends.distinct(), broadcast_rows)
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return _verified(both.select("a", "b", "text_a", "text_b"), shingle, least)


def _texts(own: DataFrame, nodes: DataFrame, few_nodes: DataFrame, broadcast_rows: int) -> DataFrame:
    """(node, text) of these nodes."""
    wanted = few_nodes.join(nodes.select("node", "id"), "node").select("node", F.col("id").alias("first"))
    wanted = store.written(wanted, "wanted")
    few = store.small(wanted, broadcast_rows)
    texts = own.join(F.broadcast(wanted) if few else wanted, "node").where(F.col("id").eqNullSafe(F.col("first"))).select("node", "text").dropDuplicates(["node"])
    return store.written(texts, "texts")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, rows: int = ROWS, bands: int = BANDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, with all their columns, of which each class keeps one row: that with its smallest doc_id, null being the largest.

    Null texts are one class with empty ones; of rows that are alike one stays; an empty table
    gives an empty one; columns may have any names.
    """
    with store.passing():
        found = store.written(classes(docs, doc_id=doc_id, text=text, shingle=shingle, least=least, rows=rows, bands=bands, broadcast_rows=broadcast_rows), "row-classes")
        gone = store.kept(store.written(found.where(~F.col("keep")).select(F.col("id").alias("_gone_id"), F.col("node").alias("_gone_node")).distinct(), "gone"))
        again = found.where("keep").groupBy("id", "node").count().where("count > 1").limit(1).count()
    few = store.small(gone, broadcast_rows)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_gone_id")) & (F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))) == F.col("_gone_node"))
    rest = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    return rest.dropDuplicates([doc_id, text]) if again else rest  # rows that are alike are found again by their text
