"""k-NN graphs as edge tables (src, slot, dst, distance), and searches over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.distance import TINY, distance
from nearfield.operators.ivf import MARGIN, TRIALS
from nearfield.operators.knn import NAMES, best_per_query, exact_distances, knn_join, matrix, pairwise, sent_queries
from nearfield.plans.config import ConstructionFailed, SearchFailed
from nearfield.plans.planner import BROADCAST_BYTES
from nearfield.runtime import FILE_ROWS, discard, materialize, prepare, scratch

def exact_graph(corpus: DataFrame, degree: int, metric: str = "cosine", form: str | None = None) -> DataFrame:
    """Edges to the degree nearest other rows, by a k-NN self-join."""
    found = knn_join(corpus, corpus, degree + 1, metric, form).where("query_id <> id")
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("slot", slot).where(F.col("slot") <= degree).select(F.col("query_id").alias("src"), (F.col("slot") - 1).alias("slot"), F.col("id").alias("dst"), "distance")


def trials(corpus: DataFrame, k: int, metric: str) -> tuple[DataFrame, DataFrame]:
    """TRIALS rows of the corpus that stand for queries, by a hash of the id, and rows (query_id, id): the k nearest others of each, by an
    exact search."""
    rows = materialize(corpus.select("id", "vector").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(TRIALS), "trials")
    near = best_per_query(knn_join(rows, corpus.select("id", "vector"), k + 1, metric).where("query_id <> id").drop("rank"), k)
    return rows, materialize(near.select("query_id", "id"), "truth")


def share_found(found: DataFrame, truth: DataFrame) -> float:
    """The share of the rows (query_id, id) of truth that are in found."""
    return truth.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / max(1, truth.count())


#: Of the nodes that point at one, so many times the degree are in its list: few rows, such as short vectors, are near to very many.
REVERSE = 6
#: Nodes whose lists one task joins with each other at a time.
VIAS = 64


def improving(lists: DataFrame, corpus: DataFrame, far: DataFrame, degree: int, metric: str, cross: bool = False) -> DataFrame:
    """Rows (src, dst, distance) of a local join: lists are rows (via, id, fresh, side), and two members of a list, of which one is
    fresh, are tried against each other. far: rows (id, far), the distance that a new neighbour must stay below.

    A member's vector is fetched once for each list it stands in; no pair of vectors is shuffled. A list's pairs are one matrix
    product, and only pairs that improve one side leave the task, at most degree a node of those tried together. cross: only
    members of different sides are tried.
    """
    prepare(corpus.sparkSession)
    kind = corpus.schema["id"].dataType
    held = corpus.select("id", "vector").join(far, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    group = F.pmod(F.xxhash64("via"), F.lit(1 << 20)).alias("group")  # split below into whole lists
    joined = lists.select(group, "via", "id", "fresh", "side").join(held, "id").select("group", "via", "id", "fresh", "side", "vector", "far")
    spread = joined.repartition("group").sortWithinPartitions("group", "via", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "via", VIAS):
            ids, rows = table["id"].combine_chunks(), matrix(table["vector"])
            far, fresh, side = table["far"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False), table["side"].to_numpy()
            via = table["via"].combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], via[1:] != via[:-1])))
            a, b = [], []
            for x, y in zip(starts, np.append(starts[1:], len(via))):
                part = pairwise(rows[x:y], rows[x:y], metric)
                wanted = (part < np.maximum(far[x:y, None], far[x:y])) & (fresh[x:y, None] | fresh[x:y])
                if cross:
                    wanted &= (side[x:y, None] != side[x:y]) | (side[x:y] == 2)
                i, k = np.nonzero(np.triu(wanted, 1))
                a.append(i + x)
                b.append(k + x)
            a, b = np.concatenate(a), np.concatenate(b)
            d = exact_distances(rows[a], rows[b], metric) if len(a) else np.zeros(0)
            src, dst, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
            # The same pair may meet in several lists of the table.
            own = ids.dictionary_encode().indices.to_numpy()
            keep = np.flatnonzero((d < far[src]) & (own[src] != own[dst]))
            _, first = np.unique(own[src[keep]].astype(np.int64) << 32 | own[dst[keep]], return_index=True)
            keep = keep[first]
            keep = keep[np.lexsort((own[dst[keep]], d[keep], own[src[keep]]))]
            node = own[src[keep]]
            keep = keep[np.arange(len(keep)) - np.searchsorted(node, node) < degree]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(src[keep])), ids.take(pa.array(dst[keep])), pa.array(d[keep])], ["src", "dst", "distance"])

    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("distance", T.DoubleType())])
    return spread.mapInArrow(run, schema)


def by_key(batches: Iterator[pa.RecordBatch], key: str, many: int) -> Iterator[pa.Table]:
    """Tables of about `many` whole runs of equal keys, of rows that lie in order."""
    held: list[pa.RecordBatch] = []
    runs, last = 0, None
    for batch in batches:
        column = batch.column(batch.schema.names.index(key))
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            new[1:] = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        start = 0
        for at in np.flatnonzero(new):
            if at == 0 and last is not None and column[0] == last:
                continue
            if runs == many:
                held.append(batch.slice(start, at - start))
                yield pa.Table.from_batches(held)
                held, runs, start = [], 0, at
            runs += 1
        if batch.num_rows:
            held.append(batch.slice(start))
            last = column[batch.num_rows - 1]
    if sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


def farthest(edges: DataFrame, degree: int) -> DataFrame:
    """Rows (id, far): the farthest neighbour's distance of the nodes whose list is full."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.max("distance").alias("far"), F.count("*").alias("_n")).where(F.col("_n") >= degree).drop("_n")


def around(edges: DataFrame, degree: int) -> DataFrame:
    """Rows (via, id, fresh, side): each node's list of those it points at (side 0) and of the nearest REVERSE * degree that point at it
    (side 1), side 2 being both. A fresh edge is fresh from both ends."""
    out = edges.select(F.col("src").alias("via"), F.col("dst").alias("id"), "fresh", F.lit(0).alias("side"))
    rank = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("fresh"), "distance", "src"))
    back = edges.withColumn("_rank", rank).where(F.col("_rank") <= REVERSE * degree).select(F.col("dst").alias("via"), F.col("src").alias("id"), "fresh", F.lit(1).alias("side"))
    both = out.unionByName(back).groupBy("via", "id").agg(F.max("fresh").alias("fresh"), F.when(F.min("side") < F.max("side"), 2).otherwise(F.min("side")).alias("side"))
    # The node itself, so that it meets those that point at it.
    return both.unionByName(edges.select(F.col("src").alias("via")).distinct().select("via", F.col("via").alias("id"), F.lit(False).alias("fresh"), F.lit(2).alias("side")))


def nn_descent(corpus: DataFrame, degree: int, metric: str = "cosine", iterations: int = 20, threshold: float = 0.001, cross: bool = False, tune: tuple[int, float] | None = None) -> DataFrame:
    """An approximate k-NN graph: the neighbours of each node, both ways, are tried against each other until few edges change.

    Edges are fresh until they were tried once, and pairs of old ones are not tried again. Reverse neighbours are limited to
    REVERSE * degree a node, so a hub's list stays bounded. Starts from rows that share a bucket of a hash. cross: see improving();
    fewer pairs a round, and more neighbours missed. tune: (k, recall); the degree is doubled, and the descent goes on from the lists there are,
    until the lists of TRIALS nodes hold that share of their k nearest.
    """
    n = corpus.count()
    if n < 2 or not 0 < degree < n:
        raise ConstructionFailed("the degree must be between 1 and the number of rows - 1")
    rows = corpus.select("id", "vector")
    size = max(4 * degree, 32)
    # Each row starts in two groups by different hashes, so that groups are linked with each other.
    start = None
    for salt in (1, 2):
        part = rows.select(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, n // size))).alias("via"), "id", F.lit(True).alias("fresh"), F.lit(0).alias("side"))
        found = improving(part, rows, rows.select("id").limit(0).withColumn("far", F.lit(0.0)), degree, metric)
        start = found if start is None else start.unionByName(found)
    edges = _descended(materialize(_nearest(start, degree).withColumn("fresh", F.lit(True)), "graph"), rows, n, degree, metric, iterations, threshold, cross)
    if tune is not None:
        k, recall = tune
        asked, truth = trials(rows, k, metric)
        while degree < n - 1 and share_found(edges.where(F.col("slot") < k).select(F.col("src").alias("query_id"), F.col("dst").alias("id")), truth) < min(1.0, recall + MARGIN):
            degree = min(2 * degree, n - 1)
            edges = _descended(materialize(edges.withColumn("fresh", F.lit(True)), "graph"), rows, n, degree, metric, iterations, threshold, cross)
        discard(asked)
        discard(truth)
    return edges.drop("fresh")


def _descended(edges: DataFrame, rows: DataFrame, n: int, degree: int, metric: str, iterations: int, threshold: float, cross: bool) -> DataFrame:
    """Rounds of descent from written edges (src, slot, dst, distance, fresh)."""
    for _ in range(iterations):
        found = improving(around(edges, degree), rows, farthest(edges, degree), degree, metric, cross)
        both = edges.select("src", "dst", "distance", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
        once = both.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
        new = materialize(_nearest(once, degree, "fresh"), "graph")
        discard(edges)
        edges = new
        if edges.where("fresh").count() < threshold * degree * n:
            break
    return edges


def _nearest(edges: DataFrame, degree: int, *keep: str) -> DataFrame:
    """The degree nearest distinct neighbours of each node."""
    once = edges if keep else edges.groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    slot = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return once.withColumn("slot", slot - 1).where(F.col("slot") < degree).select("src", "slot", "dst", "distance", *keep)


def reverse_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(dst, src) pairs: who points at a node, the nearest limit of them."""
    if limit is None:
        return edges.select("dst", "src", "distance")
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("distance", "src"))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= limit).select("dst", "src", "distance")


def entry_point(edges: DataFrame, degree: int) -> DataFrame:
    """One row (src, mean): the node with the least mean distance to its neighbours."""
    means = edges.groupBy("src").agg((F.sum("distance") / degree).alias("mean"))
    return means.orderBy("mean", "src").limit(1)


def mean_farthest(edges: DataFrame) -> DataFrame:
    """One row (mean): the farthest neighbour's distance, averaged over nodes."""
    return edges.groupBy("src").agg(F.max("distance").alias("far")).agg(F.avg("far").alias("mean"))


#: Numbers of a batch's vectors and of their distances to each other, at most about.
PRUNED = 1 << 21


def kept_slots(rows: np.ndarray, own: np.ndarray, there: np.ndarray, degree: int, metric: str) -> np.ndarray:
    """Which neighbours stay, for many nodes at once. rows: nodes x slots x dims, a node's neighbours from the nearest on; own: their
    distances; there: which slots are in use."""
    sides = np.where(rows >= 0, 1.0, -1.0) if metric == "hamming" else rows
    products = sides @ sides.transpose(0, 2, 1)
    square = (rows**2).sum(2)
    if metric == "l2":
        apart = np.maximum(0.0, square[:, :, None] + square[:, None] - 2 * products)
    elif metric == "inner_product":
        apart = -products
    elif metric == "hamming":
        apart = (rows.shape[2] - products) / 2
    else:
        size = np.sqrt(square)[:, :, None] * np.sqrt(square)[:, None]
        apart = np.where(size < TINY, 1.0, np.maximum(0.0, 1.0 - products / np.maximum(size, TINY)))
    # Where rounding could decide, distances are computed one by one, as all others are.
    node, i, k = np.nonzero((np.abs(apart - own[:, :, None]) <= 1e-9 * (1.0 + np.abs(own)[:, :, None] + square[:, :, None])) & there[:, :, None] & there[:, None])
    if len(node):
        apart[node, i, k] = exact_distances(rows[node, i], rows[node, k], metric)
    nearer = apart < own[:, :, None]
    kept = np.zeros(own.shape, bool)
    for slot in range(own.shape[1]):
        blocked = (nearer[:, slot, :slot] & kept[:, :slot]).any(1)
        kept[:, slot] = there[:, slot] & ~blocked & (kept.sum(1) < degree)
    return kept


def prune(edges: DataFrame, corpus: DataFrame, degree: int, metric: str = "cosine") -> DataFrame:
    """Keeps a neighbour unless one kept before it is nearer to it than the node is. Nodes are taken together: their neighbours'
    products are one batch of matrices, and slots are decided one after the other for all of them."""
    prepare(corpus.sparkSession)
    vectors = corpus.select(F.col("id").alias("dst"), "vector")
    spread = edges.join(vectors, "dst").select("src", "dst", "distance", "vector").repartition("src").sortWithinPartitions("src", "distance", "dst")
    kind = edges.schema["src"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "src", 512):
            rows, d = matrix(table["vector"]), table["distance"].to_numpy()
            node = table["src"].combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            sizes = np.diff(np.append(starts, len(node)))
            many = max(1, PRUNED // max(1, int(sizes.max()) * (rows.shape[1] + int(sizes.max()))))
            for a in range(0, len(starts), many):
                first, size = starts[a : a + many], sizes[a : a + many]
                place = first[:, None] + np.arange(size.max())
                there = np.arange(size.max()) < size[:, None]
                place = np.where(there, place, 0)
                kept = kept_slots(rows[place], d[place], there, degree, metric)
                at = pa.array(place[kept])
                slot = (np.cumsum(kept, 1) - 1)[kept]
                yield pa.RecordBatch.from_arrays([table["src"].combine_chunks().take(at), pa.array(slot, pa.int32()), table["dst"].combine_chunks().take(at), table["distance"].combine_chunks().take(at)], ["src", "slot", "dst", "distance"])

    schema = T.StructType([T.StructField("src", kind), T.StructField("slot", T.IntegerType()), T.StructField("dst", kind), T.StructField("distance", T.DoubleType())])
    return spread.mapInArrow(run, schema)


def hnsw_level(key: str, levels: int = 6) -> Column:
    """floor(-log2(u)), at most levels; u comes from the md5 of the id, so reruns agree. Counted in whole numbers: u <= 2 ** -l."""
    u = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("long") + 1  # of 2 ** 52
    return sum((F.when(u <= 1 << (52 - level), 1).otherwise(0) for level in range(1, levels + 1)), F.lit(0)).cast("int")


def hnsw_layers(corpus: DataFrame, m: int = 8, levels: int = 6, metric: str = "cosine") -> DataFrame:
    """Edges (layer, src, dst, distance) of the skip layers above the base: each layer's nodes and their m nearest."""
    placed = materialize(corpus.select("id", "vector").withColumn("level", hnsw_level("id", levels)), "levels")
    out = None
    for layer in range(1, levels + 1):
        nodes = placed.where(F.col("level") >= layer).select("id", "vector")
        edges = exact_graph(nodes, m, metric, "expression" if layer > 3 else None).select(F.lit(layer).alias("layer"), "src", "dst", "distance")
        out = edges if out is None else out.unionByName(edges)
    return out


def layers_of(edges: DataFrame, corpus: DataFrame, m: int = 8, levels: int = 6, metric: str = "cosine", hops: int = 2, width: int = 8) -> DataFrame:
    """Skip layers (layer, src, dst, distance) out of a k-NN graph, without comparing all nodes of a layer: a node's candidates are the
    nodes of its layer within so many hops of the layer below (of each node's `width` nearest), and, so that few-linked nodes have some
    too, those that follow it in hash order among their bucket. The m nearest stay."""
    placed = materialize(corpus.select("id").withColumn("level", hnsw_level("id", levels)), "levels")
    below = edges.where(F.col("slot") < width).select("src", "dst", "distance")
    out = None
    for layer in range(1, levels + 1):
        nodes = materialize(placed.where(F.col("level") >= layer).select("id"), "layer")
        n = nodes.count()
        step = below.unionByName(below.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
        rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
        step = materialize(step.withColumn("_rank", rank).where(F.col("_rank") <= 2 * width).select("src", "dst"), "steps")  # of hubs too
        reached = step.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        for _ in range(hops - 1):
            further = reached.select("src", F.col("dst").alias("_at")).join(step.select(F.col("src").alias("_at"), "dst"), "_at").select("src", "dst")
            reached = reached.unionByName(further).distinct()
        inside = lambda df, c: df.join(nodes.select(F.col("id").alias(c)), c, "left_semi")
        near = inside(reached, "dst").where("src <> dst")
        # The hash stride: rows of a bucket in hash order, each with the m behind it, around the end.
        bucket = F.pmod(F.xxhash64("id", F.lit(layer)), F.lit(max(1, n // 64)))
        order = Window.partitionBy("bucket").orderBy(F.xxhash64("id", F.lit(-layer)), "id")
        lined = nodes.withColumn("bucket", bucket).withColumn("place", F.row_number().over(order) - 1).withColumn("size", F.count("*").over(Window.partitionBy("bucket")))
        ahead = lined.select(F.col("id").alias("src"), "bucket", F.explode(F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: F.pmod(F.col("place") + i, F.col("size")).cast("int"))).alias("place"))
        stride = ahead.join(lined.select("bucket", "place", F.col("id").alias("dst")), ["bucket", "place"]).where("src <> dst").select("src", "dst")
        pairs = near.unionByName(stride).distinct()
        lists = pairs.select(F.col("src").alias("via"), F.col("dst").alias("id"))
        found = materialize(_nearest(measured(lists, corpus, metric), m), "layer")
        below = found.select("src", "dst", "distance")
        edges_here = found.select(F.lit(layer).alias("layer"), "src", "dst", "distance")
        out = edges_here if out is None else out.unionByName(edges_here)
    return out


def measured(lists: DataFrame, corpus: DataFrame, metric: str) -> DataFrame:
    """Rows (src, dst, distance) of rows (via, id): the distance of each member of a node's list to the node. Members' vectors meet
    the node's own in one list, so no pair of vectors is shuffled."""
    prepare(corpus.sparkSession)
    rows = corpus.select("id", "vector")
    own = rows.select(F.col("id").alias("via"), "id", "vector", F.lit(True).alias("own"))
    members = lists.join(rows, "id").select("via", "id", "vector", F.lit(False).alias("own"))
    spread = own.join(lists.select("via").distinct(), "via", "left_semi").unionByName(members).repartition("via").sortWithinPartitions("via", F.desc("own"), "id")
    kind = corpus.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "via", 4 * VIAS):
            ids, rows, own = table["id"].combine_chunks(), matrix(table["vector"]), table["own"].to_numpy(zero_copy_only=False)
            first = np.flatnonzero(own)[np.cumsum(own) - 1]  # the node's own row comes first in its list
            keep = np.flatnonzero(~own)
            d = exact_distances(rows[first[keep]], rows[keep], metric) if len(keep) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[keep])), ids.take(pa.array(keep)), pa.array(d)], ["src", "dst", "distance"])

    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("distance", T.DoubleType())])
    return spread.mapInArrow(run, schema)


def neighbourhood(edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """Rows (id): the changed nodes and those within depth edges of them, in either direction."""
    reached = changed.select("id").distinct()
    for _ in range(depth):
        out = edges.join(reached.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        back = edges.join(reached.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        reached = reached.unionByName(out).unionByName(back).distinct()
    return reached


def repair(edges: DataFrame, corpus: DataFrame, changed: DataFrame, degree: int, metric: str = "cosine", rounds: int = 5, depth: int = 2, guard: float = 0.98) -> DataFrame:
    """Local descent around the changed nodes: the lists of the nodes within depth edges are tried against each other, in up to so
    many rounds, and only these nodes' edges change. Nodes that are no rows of the corpus any more drop out of all lists. If the mean
    distance of the region's farthest neighbours falls below guard times what it was, its lists have collapsed onto each other, and
    the edges stay as they were."""
    live = edges.join(corpus.select(F.col("id").alias("dst")), "dst", "left_semi").join(corpus.select(F.col("id").alias("src")), "src", "left_semi")
    kept = materialize(live.select("src", "dst", "distance"), "edges")
    region = materialize(neighbourhood(edges, changed, depth).join(corpus.select("id"), "id", "left_semi"), "region")
    mine = kept.join(region.select(F.col("id").alias("src")), "src", "left_semi")
    # Lists of nodes of the region, which may hold nodes around it; edges of these do not change.
    current = materialize(mine.withColumn("fresh", F.lit(True)), "local")
    nodes = region.count()
    for _ in range(rounds):
        lists = around(current, degree)
        others = lists.select("id").distinct().join(region, "id", "left_anti").withColumn("far", F.lit(float("-inf")))  # their lists stay
        found = improving(lists, corpus, farthest(current, degree).unionByName(others), degree, metric)
        both = current.select("src", "dst", "distance", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
        once = both.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
        new = materialize(_nearest(once, degree, "fresh").drop("slot"), "local")
        discard(current)
        current = new
        if current.where("fresh").count() < max(1, 0.001 * degree * nodes):
            break
    before, after = (mean_farthest(e).first()["mean"] for e in (mine, current))
    done = kept if before and after is not None and after < guard * before else kept.join(region.select(F.col("id").alias("src")), "src", "left_anti").unionByName(current.drop("fresh"))
    return _nearest(done, degree)


def link(edges: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    """Rows (src, slot, dst, distance): the whole new lists of the nodes that insertions touch. found: rows (src, dst, distance), the
    nearest nodes of each new node. A node to which a new one is nearer than its worst neighbour takes it in that one's place."""
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")
    new = found.unionByName(back)
    touched = new.select("src").distinct()
    old = edges.join(touched, "src", "left_semi").select("src", "dst", "distance")
    whole = _nearest(old.unionByName(new), degree)
    # Nodes whose list the new ones did not get into stay as they are.
    changed = whole.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src").distinct()
    return whole.join(changed, "src", "left_semi")


class Frontier:
    """Searches of many queries over a graph at once, as a bounded loop of joins.

    Each query has at most ef nodes, the nearest met so far. In a hop the nodes not yet expanded are joined with their neighbours;
    these are measured, and the ef nearest of both stay. What was met before and dropped is dropped again, for the ef-th never
    gets farther, so no list of seen nodes is carried along. A query is done when all its nodes are expanded, and the loop ends
    when all are. Nothing is collected but whether any node is left, and each hop is written, so lost executors cost one hop.
    """

    def __init__(self, queries: DataFrame, corpus: DataFrame, metric: str):
        self.asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
        self.nodes, self.metric = corpus.select("id", "vector"), metric
        n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.count = n
        self.sent = prepare(corpus.sparkSession).sparkContext.broadcast(sent_queries(queries, n)) if n * (dims or 0) * 8 <= BROADCAST_BYTES else None

    def measured(self, pairs: DataFrame) -> DataFrame:
        """Rows (query_id, id, distance) of rows (query_id, id). Queries of a checked size go to the nodes, each of which meets its
        queries at once; of more queries, each pair fetches both vectors."""
        if self.sent is None:
            met = pairs.join(self.nodes, "id").join(self.asked, "query_id")
            return met.select("query_id", "id", distance("vector", "query", self.metric).alias("distance"))
        sent, metric = self.sent, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, points = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, asked = matrix(batch.column(1)), batch.column(2)
                row, named = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy()), asked.flatten()
                place = pc.index_in(named, value_set=names).to_numpy(zero_copy_only=False)
                for a in range(0, len(row), 65536):
                    some = slice(a, a + 65536)
                    d = exact_distances(points[place[some]], rows[row[some]], metric)
                    yield pa.RecordBatch.from_arrays([named[some], batch.column(0).take(pa.array(row[some])), pa.array(d)], NAMES)

        schema = T.StructType([T.StructField("query_id", self.asked.schema["query_id"].dataType), T.StructField("id", self.nodes.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
        return pairs.groupBy("id").agg(F.collect_list("query_id").alias("asked")).join(self.nodes, "id").select("id", "vector", "asked").mapInArrow(run, schema)

    def run(self, start: DataFrame, neighbours: DataFrame, ef: int) -> DataFrame:
        """Rows (query_id, id, distance), the ef nearest. start: rows (query_id, id); neighbours: rows (src, ends)."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))

        # In no more files than the rows fill: the nodes of a beam, and those met in a hop.
        tasks = max(1, min(int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * ef * self.count // FILE_ROWS))

        def nearest(found: DataFrame) -> DataFrame:
            once = found.repartition(tasks, "query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"), F.min("open").alias("open"))
            return materialize(once.withColumn("rank", rank).where(F.col("rank") <= ef), "hop")

        hop = nearest(self.measured(start.distinct()).withColumn("open", F.lit(True)))
        while hop.where("open").limit(1).count():
            met = hop.where("open").select("query_id", F.col("id").alias("src")).join(neighbours, "src").select("query_id", F.explode("ends").alias("id")).distinct()
            closed = hop.select("query_id", "id", "distance", F.lit(False).alias("open"))
            new = nearest(closed.unionByName(self.measured(met).withColumn("open", F.lit(True))))
            discard(hop)
            hop = new
        return hop.select("query_id", "id", "distance")


def beam_search(queries: DataFrame, corpus: DataFrame, edges: DataFrame, k: int, ef: int = 64, metric: str = "cosine", layers: DataFrame | None = None, entries: int = 1, recall: float | None = None) -> DataFrame:
    """Rows (query_id, rank, id, distance): best-first search of all queries together, from the graph's entry point and entries - 1
    nodes by a hash (a graph of rows that cluster may fall apart, and a search stays in the parts it starts in), or
    down through the skip layers, in each of which a query goes to the nearest node it finds. Edges are gone both ways; of those that
    point at a node the nearest 2 * degree.

    recall: ef is the least to be taken. It is doubled until searches from TRIALS rows of the corpus find that share of their k nearest others;
    where that gains nothing, the walk does not get to some parts of the graph, and starts from 16 times as many nodes."""
    if ef < k:
        raise SearchFailed("ef must be at least k")
    spark = prepare(corpus.sparkSession)
    with scratch(spark) as keep:
        corpus = materialize(corpus.select("id", "vector"), "nodes")  # each hop reads them
        degree = max(1, (edges.agg(F.max("slot")).first()[0] or 0) + 1)

        def both_ways(e: DataFrame, limit: int) -> DataFrame:
            back = reverse_edges(e, limit).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            return materialize(e.select("src", "dst").unionByName(back).groupBy("src").agg(F.collect_set("dst").alias("ends")), "neighbours")

        numbers = sorted((r[0] for r in layers.select("layer").distinct().collect()), reverse=True) if layers is not None else []  # one row a layer
        if numbers:
            entry = layers.where(F.col("layer") == numbers[0]).agg(F.min("src").alias("id"))
        else:
            entry = entry_point(edges, degree).select(F.col("src").alias("id"))  # one row
        steps = [both_ways(layers.where(F.col("layer") == number), 2 * degree) for number in numbers]
        base = both_ways(edges, 2 * degree)

        def entered(front: Frontier) -> DataFrame:
            start = front.asked.select("query_id").crossJoin(F.broadcast(entry))
            for step in steps:
                start = front.run(start, step, 1).select("query_id", "id")
            return start

        def walked(front: Frontier, start: DataFrame, ef: int, entries: int) -> DataFrame:
            if entries > 1:
                more = front.nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(entries - 1)
                start = start.unionByName(front.asked.select("query_id").crossJoin(F.broadcast(more)))  # at most as many rows as entries
            return front.run(start, base, ef)

        if recall is not None:
            n = corpus.count()
            asked, truth = trials(corpus, k, metric)
            front, before = Frontier(asked, corpus, metric), 0.0
            start, ef = materialize(entered(front), "start"), max(ef, k + 1)  # a trial's own row is one of those found
            while ef < n:
                with scratch(spark):
                    share = share_found(best_per_query(walked(front, start, ef, entries).where("query_id <> id"), k), truth)
                if share >= min(1.0, recall + MARGIN):
                    break
                if share - before < 0.005 and entries < n:
                    entries = min(n, 16 * entries)
                else:
                    ef = min(n, 2 * ef)
                before = share
        front = Frontier(queries, corpus, metric)
        found = walked(front, entered(front), ef, entries)
        return keep(materialize(best_per_query(found, k), "beam"))
