"""Product quantisation, and inverted lists of quantised residuals (IVF-PQ).

Distances of codes are sums of table entries. For l2 the tables are of the query's residual; cosine
is l2 of normalised vectors, halved; for inner products the tables hold -q.r of the query
itself, and -q.centroid is added.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators import kmeans
from nearfield.functions.distance import TINY, distance
from nearfield.operators.ivf import MARGIN, TRIALS, IVFFlat, asked_of, nearest_lists, packed, shelves
from nearfield.operators.knn import CORPUS_BLOCK, NAMES, QUERY_BLOCK, Best, _order, _pairs_schema, best_per_query, exact_distances, knn_join, matrix, packed_rows, pairwise, sent_queries
from nearfield.plans.config import ConstructionFailed, DimensionMismatch, IdAlreadyExists, IndexEmpty, IVFPQConfig, SearchFailed
from nearfield.plans.planner import BROADCAST_BYTES
from nearfield.runtime import materialize, prepare
from nearfield.sources.store import read_json, write_json

CODES = 256


class ProductQuantizer:
    def __init__(self, codebooks: np.ndarray):
        self.codebooks = codebooks  # subspace x code x part

    @classmethod
    def train(cls, points: np.ndarray, subspaces: int = 8, iterations: int = 20, seed: int = 42) -> ProductQuantizer:
        if len(points) < CODES:
            raise ConstructionFailed(f"at least {CODES} vectors are needed")
        if points.shape[1] % subspaces:
            raise DimensionMismatch(subspaces, points.shape[1])
        parts = points.reshape(len(points), subspaces, -1)
        return cls(np.stack([kmeans.fit(parts[:, m].copy(), CODES, iterations, "l2", seed + m) for m in range(subspaces)]))

    @property
    def dims(self) -> int:
        return self.codebooks.shape[0] * self.codebooks.shape[2]

    def encode(self, points: np.ndarray) -> np.ndarray:
        """The nearest code of each part; the lower code wins a tie."""
        parts = points.reshape(len(points), len(self.codebooks), -1)
        return np.stack([pairwise(parts[:, m], book, "l2").argmin(1) for m, book in enumerate(self.codebooks)], 1).astype(np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], 1)

    def tables(self, query: np.ndarray, metric: str = "l2") -> np.ndarray:
        parts = query.reshape(len(self.codebooks), 1, -1)
        if metric == "inner_product":
            return -(parts * self.codebooks).sum(2)
        return ((parts - self.codebooks) ** 2).sum(2)


def encode(corpus: DataFrame, quantizer: ProductQuantizer, centroids: np.ndarray | None = None) -> DataFrame:
    """Adds list_id (where centroids are given) and the codes of each vector or residual."""
    spark = prepare(corpus.sparkSession)
    shared = spark.sparkContext.broadcast((quantizer, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq, c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column(batch.schema.names.index("vector")))
            label = pairwise(points, c, "l2").argmin(1) if c is not None else np.zeros(len(points), np.int64)
            codes = pq.encode(points - c[label] if c is not None else points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.int32()), pa.array(list(codes), pa.list_(pa.int16()))], [*batch.schema.names, "list_id", "codes"])

    return corpus.mapInArrow(run, T.StructType([*corpus.schema.fields, T.StructField("list_id", T.IntegerType()), T.StructField("codes", T.ArrayType(T.ShortType()))]))


def normalize(corpus: DataFrame) -> DataFrame:
    from nearfield.functions.distance import normalized

    return corpus.withColumn("vector", normalized("vector"))


#: Queries whose tables are built at once, and rows whose codes are looked up in them at once: the sums stay in the cache.
TABLES, GATHERED = 128, 2048


def adc_best(tables: np.ndarray, base: np.ndarray, codes: np.ndarray, ids: pa.Array, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, distance) of each query's k best rows by its tables (queries x subspaces x codes), of those
    that are not worse than kth."""
    places, rows, found = [], [], []
    columns = codes.T.astype(np.intp)
    for start in range(0, len(codes), GATHERED):
        part = columns[:, start : start + GATHERED]
        sums = np.repeat(base[:, None], part.shape[1], axis=1)
        for m in range(len(part)):
            sums += tables[:, m].take(part[m], 1)
        bound = kth if part.shape[1] <= k else np.minimum(kth, np.partition(sums, k - 1, axis=1)[:, k - 1])
        place, row = np.nonzero(sums <= bound[:, None])
        places.append(place)
        rows.append(row + start)
        found.append(sums[place, row])
    place, row, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((places, np.int64), (rows, np.int64), (found, float)))
    order = np.lexsort((_order(ids)[row], d, place)) if len(row) else np.zeros(0, np.int64)
    place = place[order]
    first = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[first], row[order[first]], d[order[first]]


def adc_search(coded: DataFrame, quantizer: ProductQuantizer, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Rows (query_id, rank, id, distance) by the tables of each query, over given codes (id, codes), without lists. Queries
    of a checked size go to the codes where they lie, more of them meet them block by block; a task keeps k rows a query."""
    spark = prepare(coded.sparkSession)
    schema = _pairs_schema(queries, coded)
    n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()

    def nearest(points: np.ndarray, codes: pa.Array, ids: pa.Array, kth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = np.asarray(codes.flatten()).reshape(len(ids), -1)
        for a in range(0, len(points), TABLES):
            some = points[a : a + TABLES]
            place, row, d = adc_best(np.stack([quantizer.tables(p, metric) for p in some]), np.zeros(len(some)), rows, ids, k, kth[a : a + TABLES])
            yield place + a, row, d

    if n * (dims or 0) * 8 > BROADCAST_BYTES:
        left = packed_rows(queries.select("id", "vector"), "q", n, QUERY_BLOCK)
        count = coded.count()
        right = packed_rows(coded.select("id", "codes"), "c", count, CORPUS_BLOCK)
        met = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-count // CORPUS_BLOCK)) - 1)))).join(right.hint("merge"), "c")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q, c in zip(*(batch.column(batch.schema.names.index(x)) for x in ("q_rows", "c_rows"))):
                    ids = c.values.field("id")
                    points = matrix(q.values.field("vector"))
                    for place, row, d in nearest(points, c.values.field("codes"), ids, np.full(len(points), np.inf)):
                        yield pa.RecordBatch.from_arrays([q.values.field("id").take(pa.array(place)), ids.take(pa.array(row)), pa.array(d)], NAMES)

        return best_per_query(met.select("q_rows", "c_rows").mapInArrow(meet, schema), k)
    shared = spark.sparkContext.broadcast(sent_queries(queries, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points = shared.value
        best = Best(len(points), k)
        for batch in batches:
            ids = batch.column(batch.schema.names.index("id"))
            for place, row, d in nearest(points, batch.column(batch.schema.names.index("codes")), ids, best.kth) if batch.num_rows else ():
                best.add(place, ids.take(pa.array(row)), d)
        if best.held:
            place, ids, d = best.rows()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), ids, pa.array(d)], NAMES)

    return best_per_query(coded.select("id", "codes").mapInArrow(run, schema), k)


class CodeLists(IVFFlat):
    """Inverted lists whose blocks hold codes of residuals; `metric` ranks the lists."""

    quantizer: ProductQuantizer
    measure: str

    def tables(self, points: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        """For some queries and a list, their tables and what is added to each sum."""
        center = self.centroids[number]
        if self.measure == "inner_product":
            return np.stack([self.quantizer.tables(p, "inner_product") for p in points]), -(points @ center)
        half = 0.5 if self.measure == "cosine" else 1.0
        parts = (points - center).reshape(len(points), len(self.quantizer.codebooks), -1)
        books = self.quantizer.codebooks
        return np.stack([half * pairwise(parts[:, m], books[m], "l2") for m in range(len(books))], 1), np.zeros(len(points))

    def kernel(self, k: int):
        def nearest(points: np.ndarray, number: int, ids: pa.Array, dims: int, data: pa.Scalar, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes = np.frombuffer(data.as_buffer(), np.uint8).reshape(len(ids), dims)
            parts = []
            for a in range(0, len(points), TABLES):
                place, row, d = adc_best(*self.tables(points[a : a + TABLES], number), codes, ids, k, kth[a : a + TABLES])
                parts.append((place + a, row, d))
            return tuple(np.concatenate(x) for x in zip(*parts))

        return nearest

    def __getstate__(self):
        # What tasks need of it; tables of rows stay on the driver.
        return {"centroids": self.centroids, "quantizer": self.quantizer, "measure": self.measure}


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, list_id, codes) of blocks."""
    for batch in batches:
        for number, ids, dims, data in zip(*(batch.column(i) for i in range(4))):
            codes = np.frombuffer(data.as_buffer(), f"V{dims.as_py()}")
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.full(len(codes), number.as_py(), np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list_id", "codes"])


def _sums(lists: CodeLists, seen: np.ndarray, number: int, codes: np.ndarray, probed: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(queries, first row, code distances) of rows of a list and the queries that probe it, some at a time."""
    at = np.searchsorted(probed, number)
    if at == len(probed) or probed[at] != number:
        return
    columns = codes.T.astype(np.intp)
    for a in range(starts[at], starts[at + 1], TABLES):
        some = owner[a : min(a + TABLES, starts[at + 1])]
        tables, base = lists.tables(seen[some], number)
        for start in range(0, columns.shape[1], GATHERED):
            part = columns[:, start : start + GATHERED]
            sums = np.repeat(base[:, None], part.shape[1], axis=1)
            for m in range(len(part)):
                sums += tables[:, m].take(part[m], 1)
            yield some, start, sums


class IVFPQ:
    """blocks: written blocks of codes, as CodeLists has them; an index without them is trained and empty."""

    def __init__(self, config: IVFPQConfig, centroids: np.ndarray, quantizer: ProductQuantizer, blocks: DataFrame | None = None, settings: tuple[int, int] | None = None):
        self.config, self.centroids, self.quantizer, self.blocks, self.settings = config, centroids, quantizer, blocks, settings
        self.shelf_of = shelves(centroids)

    @classmethod
    def train(cls, corpus: DataFrame, config: IVFPQConfig = IVFPQConfig(), sample: int = 16_384, seed: int = 42) -> IVFPQ:
        points = kmeans.sample(normalize(corpus) if config.metric == "cosine" else corpus, sample, seed)
        if len(points) < max(CODES, config.lists):
            raise ConstructionFailed("too few training vectors")
        centroids = kmeans.fit(points, config.lists, config.iterations, "l2", seed)
        near = pairwise(points, centroids, "l2").argmin(1)
        return cls(config, centroids, ProductQuantizer.train(points - centroids[near], config.subspaces, config.iterations, seed))

    @property
    def rows(self) -> DataFrame | None:
        """Rows (id, list_id)."""
        return None if self.blocks is None else self.blocks.select(F.explode("ids").alias("id"), "list_id")

    def add(self, corpus: DataFrame) -> IVFPQ:
        """A new index with the rows too, whose codes are written; an id that is there already, or twice in corpus, is an error."""
        known = corpus.select("id") if self.rows is None else corpus.select("id").unionByName(self.rows.select("id"))
        twice = known.groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise IdAlreadyExists(str(twice[0]["id"]))
        coded = encode(normalize(corpus) if self.config.metric == "cosine" else corpus, self.quantizer, self.centroids).select("id", "list_id", "codes")
        values = lambda group: np.asarray(group["codes"].combine_chunks().flatten()).reshape(len(group), -1).astype(np.uint8)
        blocks = materialize(packed(coded, self.shelf_of, None, values), "codes")
        return IVFPQ(self.config, self.centroids, self.quantizer, blocks if self.blocks is None else self.blocks.unionByName(blocks), self.settings)

    def _lists(self) -> CodeLists:
        if self.blocks is None:
            raise IndexEmpty("nothing has been added")
        out = CodeLists(None, self.centroids, "inner_product" if self.config.metric == "inner_product" else "l2", shelf_of=self.shelf_of)
        out._blocks, out.quantizer, out.measure = self.blocks, self.quantizer, self.config.metric
        return out

    def _coded_as(self, queries: DataFrame) -> DataFrame:
        return normalize(queries) if self.config.metric == "cosine" else queries

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        """Approximate (query_id, rank, id, distance), not computed again from the vectors."""
        return self._lists().search(self._coded_as(queries), k, nprobe or self.config.nprobe)

    def tuned(self, corpus: DataFrame, k: int, recall: float = 0.9) -> IVFPQ:
        """The same index with settings (nprobe, shortlist) by which search_rescored() finds the given share of the k nearest, measured
        on rows of the corpus against an exact search. Half of what may be lost goes to the lists, half to the codes."""
        lists, metric, spark = self._lists(), self.config.metric, prepare(corpus.sparkSession)
        points = kmeans.sample(corpus.select("id", "vector"), TRIALS)
        points = points[:: max(1, len(points) // TRIALS)][:TRIALS]
        trials = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
        truth = knn_join(trials, corpus.select("id", "vector"), k + 1, metric, "kernel").where("rank > 1").select("query_id", "id")
        if metric == "cosine":
            points = points / np.maximum(np.sqrt((points**2).sum(1, keepdims=True)), 1e-30)
        held = truth.collect()  # k rows a trial
        if not held:
            return self._with((self.config.nprobe, k))
        wanted = pa.array({r["id"] for r in held}, type=pa.array([held[0]["id"]]).type)
        shared = spark.sparkContext.broadcast(wanted)
        kind = self.blocks.schema["ids"].dataType.elementType.simpleString()

        def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, ids, dims, data in zip(*(batch.column(batch.schema.names.index(c)) for c in ("list_id", "ids", "dims", "matrix"))):
                    at = np.flatnonzero(pc.is_in(ids.values, value_set=shared.value.cast(ids.values.type)).to_numpy(zero_copy_only=False))
                    codes = np.frombuffer(data.as_buffer(), np.uint8).reshape(len(ids.values), dims.as_py())[at]
                    yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(at)), pa.array([number.as_py()] * len(at), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list_id", "codes"])

        found = {r["id"]: (r["list_id"], np.frombuffer(r["codes"], np.uint8)) for r in self.blocks.select("list_id", "ids", "dims", "matrix").mapInArrow(codes_of, f"id {kind}, list_id int, codes binary").collect()}
        share = min(1.0, recall + MARGIN)
        near = nearest_lists(points, self.centroids, len(self.centroids), lists.metric)
        rank = np.argsort(near, axis=1)
        pairs = [(r["query_id"], *found[r["id"]]) for r in held if r["id"] in found]
        needed = np.sort([rank[q, number] + 1 for q, number, _ in pairs])
        nprobe = max(self.config.nprobe, int(needed[min(len(needed), math.ceil((1 + share) / 2 * len(needed))) - 1]))
        # How near a true neighbour seems by its codes, and how many candidates seem nearer.
        seen: list[list[float]] = [[] for _ in points]
        for q, number, codes in pairs:
            if rank[q, number] < nprobe:
                tables, base = lists.tables(points[q : q + 1], number)
                seen[q].append(float(base[0] + tables[0, np.arange(len(codes)), codes].sum()))
        limits = spark.sparkContext.broadcast([np.sort(x) for x in seen])
        probed, starts, owner = asked_of(near[:, :nprobe])
        asked = spark.sparkContext.broadcast((points, probed, starts, owner))

        def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points, probed, starts, owner = asked.value
            total = [np.zeros(len(x) + 1, np.int64) for x in limits.value]
            for batch in batches:
                for number, ids, dims, data in zip(*(batch.column(batch.schema.names.index(c)) for c in ("list_id", "ids", "dims", "matrix"))):
                    at = np.searchsorted(probed, number.as_py())
                    if at == len(probed) or probed[at] != number.as_py():
                        continue
                    some = owner[starts[at] : starts[at + 1]]
                    codes = np.frombuffer(data.as_buffer(), np.uint8).reshape(len(ids.values), dims.as_py()).astype(np.intp)
                    tables, base = lists.tables(points[some], number.as_py())
                    for q, table, add in zip(some, tables, base):
                        sums = add + table[np.arange(codes.shape[1]), codes].sum(1)
                        # Of equal sums the row itself is among them; rounding may not tell them apart.
                        total[q] += np.bincount(np.searchsorted(limits.value[q] + 1e-9, sums), minlength=len(total[q]))
            rows = [(q, i, int(n)) for q, counts in enumerate(total) for i, n in enumerate(np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["q", "i", "n"])

        counts = self.blocks.select("list_id", "ids", "dims", "matrix").mapInArrow(nearer, "q long, i int, n long").groupBy("q", "i").agg(F.sum("n").alias("n")).collect()  # k rows a trial
        ranks = np.sort([r["n"] for r in counts])
        enough = math.ceil(share * len(pairs))  # of all, those that no probed list holds included
        shortlist = int(ranks[min(len(ranks), enough) - 1]) if len(ranks) else k
        return self._with((nprobe, max(k, shortlist)))

    def _with(self, settings: tuple[int, int]) -> IVFPQ:
        return IVFPQ(self.config, self.centroids, self.quantizer, self.blocks, settings)

    def search_rescored(self, queries: DataFrame, corpus: DataFrame, k: int, nprobe: int | None = None, shortlist: int | None = None) -> DataFrame:
        """Exact distances of the shortlist nearest by their codes, at least, and of these the k best. Without both numbers, those of tuned().

        Queries of a checked size go to the rows: first counts of code distances give each query a bound that its shortlist lies
        below, then the codes meet their vectors, and what is below the bound is computed where it lies. No candidate is kept or
        shuffled but the k best of a task, however long the shortlist is."""
        if (nprobe is None or shortlist is None) and self.settings is None:
            raise SearchFailed("name nprobe and shortlist, or use a tuned() index")
        nprobe, shortlist = nprobe or self.settings[0], shortlist or self.settings[1]
        n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
        if n * (dims or 0) * 8 > BROADCAST_BYTES:
            q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
            pairs = self.search(queries, shortlist, nprobe).select("query_id", "id").join(corpus.select("id", "vector"), "id").join(q, "query_id")
            return best_per_query(pairs.select("query_id", "id", distance("vector", "query", self.config.metric).alias("distance")), k)
        names, points = sent_queries(queries, n)
        schema = _pairs_schema(queries, corpus)
        return best_per_query(self._rescored(names, points, corpus.select("id", "vector"), k, nprobe, shortlist, schema), k)

    def _rescored(self, names: pa.Array, points: np.ndarray, corpus: DataFrame, k: int, nprobe: int, shortlist: int, schema: T.StructType) -> DataFrame:
        lists, metric, spark = self._lists(), self.config.metric, prepare(corpus.sparkSession)
        seen = points
        if metric == "cosine":
            size = np.sqrt((points**2).sum(1, keepdims=True))
            seen = np.where(size < TINY, points, points / np.maximum(size, TINY))
        near = nearest_lists(seen, self.centroids, min(nprobe, len(self.centroids)), lists.metric) if len(points) else np.zeros((0, 1), np.int64)
        asked = asked_of(near)
        shared = spark.sparkContext.broadcast((names, points, seen, *asked, self._bounds(lists, seen, near, asked, shortlist)))
        tasks = max(spark.sparkContext.defaultParallelism, -(-self.count() // (4 * CORPUS_BLOCK)))
        kind = self.blocks.schema["ids"].dataType.elementType.simpleString()
        coded = self.blocks.select("list_id", "ids", "dims", "matrix").mapInArrow(_codes, f"id {kind}, list_id int, codes binary")
        met = coded.repartition(tasks, "id").join(corpus.repartition(tasks, "id").hint("merge"), "id").sortWithinPartitions("list_id", "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, points, seen, probed, starts, owner, bound = shared.value
            best = Best(len(points), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                number, codes, ids, rows = batch.column(0).to_numpy(), batch.column(1), batch.column(2), matrix(batch.column(3))
                codes = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(rows), -1)
                edges = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
                for x, y in zip(edges, np.append(edges[1:], len(rows))):
                    for some, start, sums in _sums(lists, seen, int(number[x]), codes[x:y], probed, starts, owner):
                        place, row = np.nonzero(sums <= bound[some][:, None])
                        row += x + start
                        d = np.concatenate([np.zeros(0), *(exact_distances(points[some[place[i : i + 65536]]], rows[row[i : i + 65536]], metric) for i in range(0, len(place), 65536))])
                        better = np.flatnonzero(d <= best.kth[some[place]])
                        best.add(some[place[better]], ids.take(pa.array(row[better])), d[better])
            if best.held:
                place, ids, d = best.rows()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), ids, pa.array(d)], NAMES)

        return met.select("list_id", "codes", "id", "vector").mapInArrow(run, schema)

    def _bounds(self, lists: CodeLists, seen: np.ndarray, near: np.ndarray, asked: tuple, shortlist: int) -> np.ndarray:
        """For each query a number below which the code distances of at least `shortlist` rows of its lists lie, or of all. The range
        that they can have is cut into buckets, and each task counts."""
        metric, spark = self.config.metric, self.blocks.sparkSession
        n, many = len(seen), max(64, min(1024, (1 << 23) // max(1, len(seen))))
        reach = math.sqrt((self.quantizer.codebooks**2).sum(2).max(1).sum())
        if metric == "inner_product":  # -q.centroid and -q.r, by Cauchy and Schwarz
            base, own = -(seen @ self.centroids.T), np.sqrt((seen**2).sum(1)) * reach
            base = np.take_along_axis(base, near, 1)
            low, high = base.min(1, initial=np.inf) - own, base.max(1, initial=-np.inf) + own
        else:  # lengths instead of squares: what is near is told apart finely
            low = np.zeros(n)
            high = np.sqrt(np.take_along_axis(pairwise(seen, self.centroids, "l2"), near, 1).max(1, initial=0.0)) + reach
            high *= math.sqrt(0.5) if metric == "cosine" else 1.0
        step = np.maximum((high - low) / many * (1 + 1e-9), 1e-300)
        shared = spark.sparkContext.broadcast((seen, *asked, low, step))
        length = metric != "inner_product"

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, probed, starts, owner, low, step = shared.value
            total = np.zeros((n, many), np.int64)
            for batch in batches:
                for number, ids, dims, data in zip(*(batch.column(batch.schema.names.index(c)) for c in ("list_id", "ids", "dims", "matrix"))):
                    codes = np.frombuffer(data.as_buffer(), np.uint8).reshape(len(ids.values), dims.as_py())
                    for some, _, sums in _sums(lists, seen, number.as_py(), codes, probed, starts, owner):
                        sums = np.sqrt(np.maximum(sums, 0.0, out=sums), out=sums) if length else sums
                        at = np.clip((sums - low[some][:, None]) / step[some][:, None], 0, many - 1).astype(np.int64)
                        total[some] += np.bincount((at + many * np.arange(len(some))[:, None]).ravel(), minlength=many * len(some)).reshape(-1, many)
            for a in range(0, n, TABLES):
                if total[a : a + TABLES].any():
                    yield pa.RecordBatch.from_arrays([pa.array([a // TABLES], pa.int32()), pa.array([total[a : a + TABLES].tobytes()], pa.binary())], ["q", "counts"])

        def sum_up(group: pa.Table) -> pa.Table:
            held = sum(np.frombuffer(c.as_buffer(), np.int64) for c in group["counts"])
            last = (np.cumsum(held.reshape(-1, many), 1) < shortlist).sum(1)  # the bucket that the shortlist ends in, or none
            return pa.table({"q": group["q"][:1], "last": pa.array([last.tolist()], pa.list_(pa.int64()))})

        found = self.blocks.select("list_id", "ids", "dims", "matrix").mapInArrow(count, "q int, counts binary").groupBy("q").applyInArrow(sum_up, "q int, last array<long>").collect()  # a number a query
        bound = np.full(n, np.inf)
        for r in found:
            part = slice(r["q"] * TABLES, r["q"] * TABLES + len(r["last"]))
            last = np.array(r["last"])
            edge = low[part] + step[part] * (last + 1)
            edge = edge**2 if length else edge
            bound[part] = np.where(last >= many - 1, np.inf, edge + 1e-9 * (1.0 + np.abs(edge)))
        return bound

    def count(self) -> int:
        return 0 if self.blocks is None else self.blocks.agg(F.sum(F.size("ids"))).first()[0] or 0

    def sizes(self) -> dict[str, int]:
        """Bytes of codes, codebooks and centroids, and of the vectors as 32-bit floats."""
        n = self.count()
        return {"codes": n * self.config.subspaces, "codebooks": self.quantizer.codebooks.size * 4, "centroids": self.centroids.size * 4, "vectors": n * self.quantizer.dims * 4}

    def save(self, path: str) -> None:
        from nearfield.sources.store import write_json

        """Codes by list, and the model with the settings of tuned()."""
        if self.blocks is None:
            raise IndexEmpty("nothing has been added")
        spark = self.blocks.sparkSession
        self.blocks.repartition("shelf").sortWithinPartitions("shelf", "list_id").write.partitionBy("shelf").parquet(f"{path}/codes")
        model = {"config": self.config.to_json(), "centroids": self.centroids.tolist(), "codebooks": self.quantizer.codebooks.tolist(), "settings": self.settings, "schema": self.blocks.schema.json()}
        write_json(spark, f"{path}/model.json", model)

    @classmethod
    def load(cls, spark, path: str) -> IVFPQ:
        model = read_json(spark, f"{path}/model.json")
        blocks = spark.read.schema(T.StructType.fromJson(json.loads(model["schema"]))).parquet(f"{path}/codes")
        return cls(IVFPQConfig.from_json(model["config"]), np.array(model["centroids"]), ProductQuantizer(np.array(model["codebooks"])), blocks, tuple(model["settings"]) if model["settings"] else None)
