"""Exact nearest neighbours: single queries, k-NN joins, range search, and what follows a search.

A corpus has the columns id and vector, and any others. All results rank by (distance, id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.distance import TINY, distance
from nearfield.plans.config import DimensionMismatch, SearchFailed
from nearfield.plans.planner import BROADCAST_BYTES, KERNEL_PAIRS
from nearfield.runtime import prepare

CORPUS_BLOCK = 8192
QUERY_BLOCK = 1024
#: Products of single precision are made and read in strips of this size.
STRIP_BYTES = 2 << 20


def literal(vector) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(corpus: DataFrame, query, k: int, metric: str = "cosine") -> DataFrame:
    """Rows (rank, id, distance) of the k nearest to one query. k <= 0 gives none."""
    if k <= 0:
        return corpus.select(F.lit(0).alias("rank"), "id", F.lit(0.0).alias("distance")).limit(0)
    found = corpus.select("id", distance("vector", literal(query), metric).alias("distance")).orderBy("distance", "id").limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select("rank", "id", "distance")  # at most k rows


def range_search(corpus: DataFrame, query, radius: float, metric: str = "cosine", limit: int | None = 1000) -> DataFrame:
    """Rows (id, distance) with distance <= radius, nearest first. A negative radius gives
    none, except for inner products, whose distances are negative."""
    if (radius < 0 and metric != "inner_product") or (limit is not None and limit <= 0):
        return corpus.select("id", F.lit(0.0).alias("distance")).limit(0)
    found = corpus.select("id", distance("vector", literal(query), metric).alias("distance")).where(F.col("distance") <= radius).orderBy("distance", "id")
    return found if limit is None else found.limit(limit)


def best_per_query(pairs: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, id, distance) rows of each query, ranked."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def knn_join_expression(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    """The k-NN join as one declarative plan: nested loops over broadcast queries, then ranks
    with a limit pushed below the shuffle. Queries beyond a checked size are an error."""
    n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n * (dims or 0) * 8 > BROADCAST_BYTES:
        raise SearchFailed("too many queries for a broadcast; use the blocks form")
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    pairs = corpus.select("id", "vector").crossJoin(F.broadcast(q))
    return best_per_query(pairs.select("query_id", "id", distance("vector", "query", metric).alias("distance")), k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return np.zeros((0, 0))
    if len(flat) % len(column) or len({len(column[0]), len(flat) // len(column)}) > 1:
        raise DimensionMismatch(len(column[0]), None)
    return flat.reshape(len(column), -1)


def pairwise(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """All distances by one matrix product; may differ from exact_distances in the last bits."""
    if metric == "hamming":
        return queries.shape[1] - ((queries >= 0).astype(np.float64) @ (rows >= 0).T + (queries < 0).astype(np.float64) @ (rows < 0).T)
    products = queries @ rows.T
    if metric == "inner_product":
        return -products
    a, b = (queries**2).sum(1), (rows**2).sum(1)
    if metric == "l2":
        return np.maximum(0.0, a[:, None] - 2 * products + b)
    size = np.sqrt(a)[:, None] * np.sqrt(b)
    return np.where(size < TINY, 1.0, np.maximum(0.0, 1.0 - products / np.maximum(size, TINY)))


def _total(parts: np.ndarray) -> np.ndarray:
    """Sums over the last axis, one number added after the other, as expressions and SQL add them: rows whose distances differ
    in rounding only, such as one vector in several lengths under cosine, rank alike in all forms."""
    return np.cumsum(parts, axis=-1)[..., -1] if parts.shape[-1] else np.zeros(parts.shape[:-1])


def exact_distances(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances row by row, of one query or of as many as there are rows; summed in the same order
    for every row, so equal rows tie."""
    if metric == "l2":
        return _total((rows - query) ** 2)
    if metric == "hamming":
        return ((rows >= 0) != (query >= 0)).sum(1).astype(np.float64)
    products = _total(rows * query)
    if metric == "inner_product":
        return -products
    size = np.sqrt(_total(query**2)) * np.sqrt(_total(rows**2))
    return np.where(size < TINY, 1.0, np.maximum(0.0, 1.0 - products / np.maximum(size, TINY)))


def _single(queries: np.ndarray, rows: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Two matrices of single precision whose product ranks a query's rows as their distances do, and for each
    query twice the most by which a product may be off. None where single precision cannot hold the numbers."""
    if metric == "hamming":  # sums of signs are exact
        return np.where(queries >= 0, 1, -1).astype(np.float32), np.where(rows >= 0, -1, 1).astype(np.float32), np.zeros(len(queries))
    a, b = np.sqrt((queries**2).sum(1)), np.sqrt((rows**2).sum(1))
    long, most = float(b.max()), float(a.max())
    if not long * max(most, long) < 1e30:  # too large, or not finite
        return None
    off = (queries.shape[1] + 4) * 2.0**-23 * 1.01  # rounding of both sides and of the sum, by Cauchy and Schwarz
    if metric == "cosine":
        if any(((0 < n) & (n < 2 * TINY**0.5)).any() for n in (a, b)):
            return None
        return (queries / np.where(a == 0, 1, a)[:, None]).astype(np.float32), (-rows / np.where(b == 0, 1, b)[:, None]).astype(np.float32), np.full(len(a), off)
    if metric == "inner_product":
        return queries.astype(np.float32), (-rows).astype(np.float32), off * a * long + 1e-30
    left = np.concatenate([queries, np.ones((len(queries), 1))], 1)  # l2 without the query's own square
    return left.astype(np.float32), np.concatenate([-2 * rows, (b**2)[:, None]], 1).astype(np.float32), off * (2 * a * long + long**2) + 1e-30


def _near(queries: np.ndarray, rows: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(query place, row place) of pairs among which are each query's k best, by products of single precision in strips
    that stay in the cache. The k-th of the least of groups bounds the k-th of all. None where this leaves too many."""
    sides = _single(queries, rows, metric)
    if sides is None:
        return None
    left, right, slack = sides
    n, k = len(rows), int(k)
    group = min(32, n // (4 * k))
    strip = max(1, STRIP_BYTES // (4 * n))
    products = np.empty((min(strip, len(left)), n), np.float32)
    places, spare = [], 16 * k * len(left) + 65536
    for start in range(0, len(left), strip):
        part = left[start : start + strip]
        found = np.matmul(part, right.T, out=products[: len(part)])
        least = found[:, : n // group * group].reshape(len(part), group, n // group).min(1) if group > 1 else found
        worst = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64) + slack[start : start + strip]
        at = np.flatnonzero(found <= np.nextafter(worst.astype(np.float32), np.float32(np.inf))[:, None])
        spare -= len(at)
        if spare < 0:
            return None
        places.append(at + start * n)
    return np.divmod(np.concatenate(places), n)


def block_best(queries: np.ndarray, rows: np.ndarray, ids: pa.Array, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows of a block: (query place, row place, distance). A matrix
    product bounds the candidates, which are then computed again one by one."""
    if not len(queries) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    near = _near(queries, rows, k, metric) if len(rows) > k else tuple(x.ravel() for x in np.indices((len(queries), len(rows))))
    if near is None:
        found = pairwise(queries, rows, metric)
        worst = np.partition(found, k - 1, axis=1)[:, k - 1]
        near = np.nonzero(found <= (worst + 1e-9 * (1.0 + np.abs(found).max(initial=0.0, where=np.isfinite(found))))[:, None])
    place, row = near
    exact = np.concatenate([exact_distances(queries[place[i : i + 65536]], rows[row[i : i + 65536]], metric) for i in range(0, len(place), 65536)])
    key = ids.to_numpy(zero_copy_only=False)
    if key.dtype == object:  # names: their order serves as number
        key = np.argsort(np.argsort(key, kind="stable"), kind="stable")
    order = np.lexsort((key[row], exact, place))
    place = place[order]
    first = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[first], row[order[first]], exact[order[first]]


def _pairs_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", corpus.schema["id"].dataType), T.StructField("distance", T.DoubleType())])


def within(queries: np.ndarray, rows: np.ndarray, radius: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, distance) of all pairs with distance <= radius; a matrix product bounds the candidates."""
    found = pairwise(queries, rows, metric)
    if not found.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    place, row = np.nonzero(found <= radius + 1e-9 * (1.0 + np.abs(found).max()))
    parts = [exact_distances(queries[place[i : i + 65536]], rows[row[i : i + 65536]], metric) for i in range(0, len(place), 65536)]
    exact = np.concatenate([np.zeros(0), *parts])
    keep = exact <= radius
    return place[keep], row[keep], exact[keep]


def _order(ids: pa.Array) -> np.ndarray:
    key = ids.to_numpy(zero_copy_only=False)
    return np.argsort(np.argsort(key, kind="stable"), kind="stable") if key.dtype == object else key


def sent_queries(queries: DataFrame, checked: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """Ids and matrix of queries that are to be broadcast. Their size is checked before anything is collected, unless
    the caller did so."""
    if checked is None:
        n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
        if n * (dims or 0) * 8 > BROADCAST_BYTES:
            raise SearchFailed("too many queries for a broadcast; use the blocks form")
    table = queries.select("id", "vector").toArrow()
    return table["id"].combine_chunks(), matrix(table["vector"])


class Best:
    """The k best (query place, id, distance) rows of each query among those added, in about k rows a query."""

    def __init__(self, queries: int, k: int):
        self.k, self.most = k, max(65536, 4 * queries * k)
        self.kth = np.full(queries, np.inf)  # what no later row may exceed, as known at the last look
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, place: np.ndarray, ids: pa.Array, distance: np.ndarray) -> None:
        self.held.append((place, ids, distance))
        self.size += len(place)
        if self.size > self.most:
            self.held = [self.rows()]
            places, _, kept = self.held[0]
            self.size = len(places)
            last = np.searchsorted(places, np.arange(len(self.kth)), "right")
            full = last - np.searchsorted(places, np.arange(len(self.kth))) == self.k
            self.kth[full] = kept[last[full] - 1]

    def rows(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        place, distance = (np.concatenate([h[i] for h in self.held]) for i in (0, 2))
        ids = pa.concat_arrays([h[1] for h in self.held])
        order = np.lexsort((_order(ids), distance, place))
        place = place[order]
        first = np.arange(len(place)) - np.searchsorted(place, place) < self.k
        return place[first], ids.take(pa.array(order[first])), distance[order[first]]


NAMES = ["query_id", "id", "distance"]


def _kernel(queries: DataFrame, corpus: DataFrame, metric: str, k: int | None, radius: float | None) -> DataFrame:
    """Pairs by matrix products: the corpus stays where it is and meets the broadcast queries. With k, a
    task gives the k best rows of its partition for every query, else all within the radius."""
    spark = prepare(corpus.sparkSession)
    shared = spark.sparkContext.broadcast(sent_queries(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        best = Best(len(q), k or 0)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            for start in range(0, batch.num_rows, CORPUS_BLOCK):
                part = batch.slice(start, CORPUS_BLOCK)
                rows = matrix(part.column(1))
                if rows.shape[1] != q.shape[1]:
                    raise DimensionMismatch(rows.shape[1], q.shape[1])
                for a in range(0, len(q), QUERY_BLOCK):
                    if k is not None:
                        place, row, d = block_best(q[a : a + QUERY_BLOCK], rows, part.column(0), k, metric)
                        best.add(place + a, part.column(0).take(pa.array(row)), d)
                    else:
                        place, row, d = within(q[a : a + QUERY_BLOCK], rows, radius, metric)
                        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(place + a)), part.column(0).take(pa.array(row)), pa.array(d)], NAMES)
        if best.held:
            place, ids, d = best.rows()
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(place)), ids, pa.array(d)], NAMES)

    return corpus.select("id", "vector").mapInArrow(run, _pairs_schema(queries, corpus))


def packed_rows(df: DataFrame, side: str, rows: int, size: int) -> DataFrame:
    """Rows (side, side_rows): all columns of about size rows a block, by a hash of the id."""
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows // size)))).cast("int").alias(side)
    return df.select(block, F.struct(*df.columns).alias("row")).groupBy(side).agg(F.collect_list("row").alias(f"{side}_rows"))


def _blocks(queries: DataFrame, corpus: DataFrame, metric: str, k: int | None, radius: float | None) -> DataFrame:
    """The same for any number of queries: blocks of queries meet blocks of the corpus, nothing is broadcast."""
    prepare(corpus.sparkSession)

    rows = corpus.count()
    blocks = max(1, -(-rows // CORPUS_BLOCK))
    left = packed_rows(queries.select("id", "vector"), "q", queries.count(), QUERY_BLOCK)
    right = packed_rows(corpus.select("id", "vector"), "c", rows, CORPUS_BLOCK)
    met = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right.hint("merge"), "c")
    return met.select("q_rows", "c_rows").mapInArrow(meeting(metric, k, radius), _pairs_schema(queries, corpus))


def meeting(metric: str, k: int | None, radius: float | None = None):
    """Of rows (q_rows, c_rows), lists of (id, vector): each query's k best of the block, or all within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = (batch.column(batch.schema.names.index(n))[i].values for n in ("q_rows", "c_rows"))
                a, b = matrix(q.field("vector")), matrix(c.field("vector"))
                place, row, d = block_best(a, b, c.field("id"), k, metric) if k is not None else within(a, b, radius, metric)
                yield pa.RecordBatch.from_arrays([q.field("id").take(pa.array(place)), c.field("id").take(pa.array(row)), pa.array(d)], NAMES)

    return run


def knn_join_kernel(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    """The k-NN join by matrix products over broadcast queries of a checked size."""
    return best_per_query(_kernel(queries, corpus, metric, k, None), k)


def knn_join_blocks(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    """The k-NN join for any number of queries."""
    return best_per_query(_blocks(queries, corpus, metric, k, None), k)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", form: str | None = None) -> DataFrame:
    """Rows (query_id, rank, id, distance). form None chooses by the checked sizes of both sides."""
    if k <= 0:
        return best_per_query(queries.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance")), 0)
    if form is None:
        n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
        rows = corpus.count()
        small = n * (dims or 0) * 8 <= BROADCAST_BYTES
        form = "expression" if n * rows < KERNEL_PAIRS and small else "kernel" if small else "blocks"
    return {"expression": knn_join_expression, "kernel": knn_join_kernel, "blocks": knn_join_blocks}[form](queries, corpus, k, metric)


#: Matches that a task holds at a time, about, and matches up to which they are shuffled to be ranked.
HELD_PAIRS, SHUFFLED_PAIRS = 1 << 23, 1 << 24


def _many_within(queries: DataFrame, corpus: DataFrame, radius: float, metric: str, form: str, n: int, rows: int) -> bool:
    """Whether more than SHUFFLED_PAIRS pairs are within the radius, as a share of the corpus by a hash of the id has it. This
    chooses a plan only; the join itself reads all rows."""
    if n * rows <= SHUFFLED_PAIRS:
        return False
    share = min(1.0, max(SHUFFLED_PAIRS / 4 / (n * rows), 1024 / rows))
    some = corpus.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return {"kernel": _kernel, "blocks": _blocks}[form](queries, some, metric, None, radius).count() > share * SHUFFLED_PAIRS


def _ranked_whole(queries: DataFrame, corpus: DataFrame, radius: float, metric: str, n: int, rows: int) -> DataFrame:
    """Rows (query_id, rank, id, distance) without a shuffle of pairs: a task has some queries and reads the whole corpus, whose blocks are
    written once, as one partition that every task reads. It holds about HELD_PAIRS matches and ranks them a query at a time."""
    spark = prepare(corpus.sparkSession)
    size = max(1, min(HELD_PAIRS // rows, -(-n // spark.sparkContext.defaultParallelism)))
    left = packed_rows(corpus.select("id", "vector"), "c", rows, CORPUS_BLOCK).select("c_rows").repartition(1)
    right = packed_rows(queries.select("id", "vector"), "q", n, size).repartitionByRange(-(-n // size), "q")
    met = left.hint("shuffle_replicate_nl").crossJoin(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[pa.Array, np.ndarray]] = {}
        held: dict[int, list[tuple[np.ndarray, pa.Array, np.ndarray]]] = {}
        for batch in batches:
            for q, q_rows, c_rows in zip(*(batch.column(batch.schema.names.index(c)) for c in ("q", "q_rows", "c_rows"))):
                q, c = q.as_py(), c_rows.values
                if q not in asked:
                    asked[q], held[q] = (q_rows.values.field("id"), matrix(q_rows.values.field("vector"))), []
                place, row, d = within(asked[q][1], matrix(c.field("vector")), radius, metric)
                held[q].append((place.astype(np.int32), c.field("id").take(pa.array(row)), d))
        for q in list(held):
            names, parts = asked[q][0], held.pop(q)
            starts = [np.searchsorted(place, np.arange(len(names) + 1)) for place, _, _ in parts]  # matches of a block lie by query
            for i in range(len(names)):
                some = [slice(at[i], at[i + 1]) for at in starts]
                ids, d = pa.concat_arrays([p[1][x] for p, x in zip(parts, some)]), np.concatenate([p[2][x] for p, x in zip(parts, some)])
                order = np.lexsort((_order(ids), d))
                for a in range(0, len(order), 65536):
                    part = order[a : a + 65536]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(part), i))), pa.array(np.arange(a + 1, a + 1 + len(part), dtype=np.int32)), ids.take(pa.array(part)), pa.array(d[part])], ["query_id", "rank", "id", "distance"])

    kinds = _pairs_schema(queries, corpus)
    return met.select("q", "q_rows", "c_rows").mapInArrow(run, T.StructType([kinds[0], T.StructField("rank", T.IntegerType()), *kinds[1:]]))


def range_join(queries: DataFrame, corpus: DataFrame, radius: float, metric: str = "cosine", limit: int | None = 1000, form: str | None = None) -> DataFrame:
    """All (query_id, rank, id, distance) with distance <= radius, ranked, at most limit a query. form: kernel
    (broadcast queries of a checked size) or blocks; None chooses by that size. Without a limit, where very many pairs are
    within the radius, they are ranked by the task that finds them instead of being shuffled."""
    if radius < 0 and metric != "inner_product":
        queries = queries.limit(0)
    n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if form is None:
        form = "kernel" if n * (dims or 0) * 8 <= BROADCAST_BYTES else "blocks"
    if limit is None:
        rows = corpus.count()
        if rows <= HELD_PAIRS and _many_within(queries, corpus, radius, metric, form, n, rows):
            return _ranked_whole(queries, corpus, radius, metric, n, rows)
    found = {"kernel": _kernel, "blocks": _blocks}[form](queries, corpus, metric, None, radius)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    found = found.withColumn("rank", rank).select("query_id", "rank", "id", "distance")
    return found if limit is None else found.where(F.col("rank") <= limit)


def live(corpus: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows that are not deleted."""
    return corpus.join(tombstones.select("id"), "id", "left_anti")


def post_process(found: DataFrame, k: int, tombstones: DataFrame | None = None, keep=None, radius: float | None = None, id_map: DataFrame | None = None) -> DataFrame:
    """What follows any search, in this order: deleted rows go, the predicate holds, the radius
    holds, internal ids become external ones (rows without go), k are left."""
    if tombstones is not None:
        found = live(found, tombstones)
    if keep is not None:
        found = found.where(keep)
    if radius is not None:
        found = found.where(F.col("distance") <= radius)
    if id_map is not None:
        found = found.join(id_map, "id")
    return found.orderBy("distance", "id").limit(k)


def merge_results(*parts: DataFrame, k: int | None = None) -> DataFrame:
    """Lists of (query_id, id, distance) as one: an id's smallest distance counts, then the k best a query."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    best = whole.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return best if k is None else best_per_query(best, k)
