"""Inverted lists: exact vectors in lists around centroids, of which the nearest are read. Shards are the same with few, large lists.

An index is a folder: blocks of packed vectors by list, the centroids, and a manifest with the metric and the number of
probes that was measured when it was built. Lists whose centroids are near each other share a shelf, and shelves
are directories: a search works out first which lists its queries probe, so the files of other shelves are never
opened, and row groups of other lists are passed over.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators import kmeans
from nearfield.operators.knn import CORPUS_BLOCK, NAMES, QUERY_BLOCK, Best, best_per_query, block_best, matrix, pairwise, sent_queries
from nearfield.plans.config import CorruptFile, IndexEmpty, ShardConfig
from nearfield.plans.planner import BROADCAST_BYTES, list_count
from nearfield.runtime import ROW_GROUPS, prepare, work_path
from nearfield.sources import store

#: Rows that stand for the queries when the number of probes is measured, and the share of true
#: neighbours they must find: above the recall asked for, for other queries may find fewer.
TRIALS, MARGIN = 256, 0.03


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str) -> DataFrame:
    """Rows (query_id, query, list_id): the nprobe nearest lists of each query."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_lists(matrix(batch.column(1)), shared.value, nprobe, metric)
                place = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(near.ravel().astype(np.int32))], ["query_id", "query", "list_id"])

    kind = queries.schema
    schema = T.StructType([T.StructField("query_id", kind["id"].dataType), T.StructField("query", kind["vector"].dataType), T.StructField("list_id", T.IntegerType())])
    return queries.select("id", "vector").mapInArrow(run, schema)


def nearest_lists(points: np.ndarray, centroids: np.ndarray, nprobe: int, metric: str) -> np.ndarray:
    """The numbers of the nprobe nearest lists of each point, the nearest first; of equal ones the lower number."""
    out = [np.argsort(pairwise(points[i : i + QUERY_BLOCK], centroids, metric), axis=1, kind="stable")[:, :nprobe] for i in range(0, len(points), QUERY_BLOCK)]
    return np.concatenate(out) if out else np.zeros((0, nprobe), np.int64)


def shelves(centroids: np.ndarray, seed: int = 42) -> np.ndarray:
    """The shelf of each list: about the square root of their number, by k-means of the centroids."""
    count = max(1, math.isqrt(len(centroids)))
    return pairwise(centroids, kmeans.fit(centroids, count, 8, "l2", seed), "l2").argmin(1)


def pack(assigned: DataFrame, shelf_of: np.ndarray, rows: int | None = None) -> DataFrame:
    """Rows (shelf, list_id, part, ids, dims, matrix) of (id, vector, list_id): blocks of about CORPUS_BLOCK vectors at most, in the
    precision that they have. A list beyond that takes several parts."""
    single = assigned.schema["vector"].dataType.elementType == T.FloatType()
    return packed(assigned, shelf_of, rows, lambda group: matrix(group["vector"]).astype("<f4" if single else "<f8"))


def packed(assigned: DataFrame, shelf_of: np.ndarray, rows: int | None, values: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Blocks of the matrices that values makes of rows (list_id, id, ...)."""
    spark = assigned.sparkSession
    part = F.lit(0)
    if rows is None or rows > CORPUS_BLOCK:
        sizes = assigned.groupBy("list_id").agg(F.ceil(F.count("*") / CORPUS_BLOCK).cast("int").alias("parts"))  # one row a list
        assigned = assigned.join(F.broadcast(sizes), "list_id")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    shared = spark.sparkContext.broadcast(shelf_of.astype(np.int32))

    def run(group: pa.Table) -> pa.Table:
        held = values(group)
        number = group["list_id"][0].as_py()
        ids = pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group["id"].combine_chunks())
        return pa.table({"shelf": pa.array([shared.value[number]], pa.int32()), "list_id": pa.array([number], pa.int32()), "part": group["part"][:1], "ids": ids, "dims": pa.array([held.shape[1]], pa.int32()), "matrix": pa.array([held.tobytes()], pa.binary())})

    kind = assigned.schema["id"].dataType.simpleString()
    return assigned.withColumn("part", part).groupBy("list_id", "part").applyInArrow(run, f"shelf int, list_id int, part int, ids array<{kind}>, dims int, matrix binary")


def unpacked(data: pa.Scalar, rows: int, dims: int) -> np.ndarray:
    buffer = data.as_buffer()
    return np.frombuffer(buffer, "<f4" if len(buffer) == 4 * rows * dims else "<f8").reshape(rows, dims).astype(np.float64)


def asked_of(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The probed lists in order, where each one's queries start, and the queries, of the lists near each query."""
    order = np.argsort(near.ravel(), kind="stable")
    lists, starts = np.unique(near.ravel()[order], return_index=True)
    return lists, np.append(starts, near.size), order // max(near.shape[1], 1)


class IVFFlat:
    """Lists of exact vectors. lists: rows (id, vector, list_id), packed and written at the first search; or, of a folder, nothing."""

    def __init__(self, lists: DataFrame | None, centroids: np.ndarray, metric: str, path: str | None = None, nprobe: int = 4, shelf_of: np.ndarray | None = None):
        self.lists, self.centroids, self.metric, self.path, self.nprobe = lists, centroids, metric, path, nprobe
        self.shelf_of = shelves(centroids) if shelf_of is None else shelf_of
        self._blocks: DataFrame | None = None

    @classmethod
    def build(cls, corpus: DataFrame, metric: str = "cosine", lists: int = 256, seed: int = 42, tune: tuple[int, float] | None = None) -> IVFFlat:
        """Centroids of a bounded sample, every row in its list, all of it written. tune: (k, recall) for which the number of
        probes is measured."""
        rows = corpus.count()
        count = list_count(lists, rows)
        points = kmeans.sample(corpus, min(rows, max(count, min(4096, 16 * count))), seed, rows)
        centroids = kmeans.fit(points, count, 8, metric, seed)
        out = cls(kmeans.assign(corpus.select("id", "vector"), centroids, metric), centroids, metric)
        out._write(rows)
        if tune is not None:
            out.nprobe = out.probes_for(*tune, trials=points[:: max(1, len(points) // TRIALS)][:TRIALS])
            out._commit()
        return out

    def _write(self, rows: int | None = None, path: str | None = None) -> None:
        """Blocks and centroids as a folder of their own, then the manifest."""
        if self.lists is None:
            blocks = self.blocks()
        else:
            blocks = pack(self.lists, self.shelf_of, rows)
        spark = blocks.sparkSession
        self.path = path or self.path or work_path(spark, "lists")
        folder = f"v-{uuid.uuid4().hex}"
        # A shelf's lists go to as many tasks as they have rows for; within a file they lie in order.
        spread = blocks.repartition("shelf", F.pmod("list_id", F.lit(max(1, (rows or 1) // (1 << 22)))))
        spread.sortWithinPartitions("shelf", "list_id").write.options(**ROW_GROUPS).partitionBy("shelf").parquet(f"{self.path}/{folder}/blocks")
        places = [(i, int(s), [float(x) for x in c]) for i, (s, c) in enumerate(zip(self.shelf_of, self.centroids))]
        spark.createDataFrame(places, "list_id int, shelf int, vector array<double>").coalesce(1).write.parquet(f"{self.path}/{folder}/centroids")
        self._kept = {"folder": folder, "kind": "lists", "schema": blocks.schema.json()}
        self.lists, self._blocks = None, None
        self._commit(spark)

    def _commit(self, spark: SparkSession | None = None) -> None:
        spark = spark or self.blocks().sparkSession
        store.commit(spark, self.path, self._kept | {"metric": self.metric, "nprobe": self.nprobe})

    def save(self, path: str) -> None:
        """The same index as a folder of its own."""
        self.blocks()
        copy = type(self)(None, self.centroids, self.metric, self.path, self.nprobe, self.shelf_of)
        copy._blocks, copy._kept = self._blocks, self._kept
        copy._write(path=path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVFFlat:
        """The newest version of a folder, with the probes that were measured when it was built."""
        kept = store.newest(spark, path)
        if kept.get("kind") != "lists" or kept.get("format") != store.FORMAT:
            raise CorruptFile(f"{path} holds no inverted lists")
        rows = spark.read.parquet(f"{path}/{kept['folder']}/centroids").orderBy("list_id").collect()  # one row a list
        out = cls(None, np.array([r["vector"] for r in rows]), kept["metric"], path, kept["nprobe"], np.array([r["shelf"] for r in rows]))
        out._kept = {k: kept[k] for k in ("folder", "kind", "schema")}
        return out

    def kernel(self, k: int) -> Callable:
        """Of some queries and a block: (query place, row place, distance) of each query's k best. kth: what each query's
        k-th distance is already."""
        metric = self.metric
        return lambda points, number, ids, dims, data, kth: block_best(points, unpacked(data, len(ids), dims), ids, k, metric)

    def blocks(self) -> DataFrame:
        """Rows (shelf, list_id, part, ids, dims, matrix); they are written first, if they are not yet."""
        if self._blocks is None:
            if self.lists is not None:
                self._write()
            if self.path is None:
                raise IndexEmpty("nothing has been built")
            spark = SparkSession.getActiveSession()
            self._blocks = spark.read.schema(T.StructType.fromJson(json.loads(self._kept["schema"]))).parquet(f"{self.path}/{self._kept['folder']}/blocks")
        return self._blocks

    def _probed(self, lists: np.ndarray) -> DataFrame:
        """The blocks of some lists: directories of other shelves are pruned, and row groups of other lists."""
        blocks = self.blocks()
        if len(lists) == len(self.centroids):
            return blocks
        return blocks.where(F.col("shelf").isin(np.unique(self.shelf_of[lists]).tolist()) & F.col("list_id").isin(lists.tolist()))

    def _found(self, names: pa.Array, points: np.ndarray, near: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
        """Pairs (query_id, id, distance): each task's k best a query, of the lists near it."""
        lists, starts, owner = asked_of(near)
        blocks = self._probed(lists)
        shared = prepare(blocks.sparkSession).sparkContext.broadcast((names, points, lists, starts, owner))
        nearest = self.kernel(k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, points, lists, starts, owner = shared.value
            best = Best(len(points), k)
            for batch in batches:
                for number, ids, dims, data in zip(*(batch.column(batch.schema.names.index(c)) for c in ("list_id", "ids", "dims", "matrix"))):
                    at = np.searchsorted(lists, number.as_py())
                    asked = owner[starts[at] : starts[at + 1]]
                    for a in range(0, len(asked), QUERY_BLOCK):
                        some = asked[a : a + QUERY_BLOCK]
                        place, row, d = nearest(points[some], number.as_py(), ids.values, dims.as_py(), data, best.kth[some])
                        best.add(some[place], ids.values.take(pa.array(row)), d)
            if best.held:
                place, ids, d = best.rows()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), ids, pa.array(d)], NAMES)

        return blocks.select("list_id", "ids", "dims", "matrix").mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        """Rows (query_id, rank, id, distance) of the nearest in the nprobe lists nearest to each query; without nprobe as many as
        were measured. Queries of a checked size go to the blocks; more of them meet the blocks in a join."""
        nprobe = min(nprobe or self.nprobe, len(self.centroids))
        ids = self.blocks().schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", ids), T.StructField("distance", T.DoubleType())])
        n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
        if n * (dims or 0) * 8 > BROADCAST_BYTES:
            return best_per_query(self._joined(queries, n, k, nprobe, schema), k)
        names, points = sent_queries(queries, n)
        return best_per_query(self._found(names, points, nearest_lists(points, self.centroids, nprobe, self.metric), k, schema), k)

    def _joined(self, queries: DataFrame, n: int, k: int, nprobe: int, schema: T.StructType) -> DataFrame:
        """Blocks of queries meet the blocks of the lists they probe; the block's number is in the key, so that a long list or
        one that many probe is spread."""
        nearest = self.kernel(k)
        asked = probes(queries, self.centroids, nprobe, self.metric)
        lists = np.array([r[0] for r in asked.select("list_id").distinct().collect()], np.int64)  # at most one row a list
        blocks = self._probed(np.sort(lists))
        counts = blocks.groupBy("list_id").agg(F.max("part").alias("last"))  # one row a list
        part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_BLOCK)))).cast("int")
        packed = asked.groupBy("list_id", part.alias("_some")).agg(F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("query").alias("vector"))).alias("q_rows"))
        packed = packed.join(F.broadcast(counts), "list_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for asked, number, ids, dims, data in zip(*(batch.column(batch.schema.names.index(c)) for c in ("q_rows", "list_id", "ids", "dims", "matrix"))):
                    points = matrix(asked.values.field("vector"))
                    place, row, d = nearest(points, number.as_py(), ids.values, dims.as_py(), data, np.full(len(points), np.inf))
                    yield pa.RecordBatch.from_arrays([asked.values.field("id").take(pa.array(place)), ids.values.take(pa.array(row)), pa.array(d)], NAMES)

        return packed.join(blocks.hint("merge"), ["list_id", "part"]).select("q_rows", "list_id", "ids", "dims", "matrix").mapInArrow(run, schema)

    def probes_for(self, k: int, recall: float = 0.9, trials: np.ndarray | None = None) -> int:
        """How many probes find the given share of the k nearest, measured on rows of this index against all lists. A trial's
        own row is not counted."""
        if trials is None:
            some = self.blocks().orderBy("list_id").limit(64).select("ids", "dims", "matrix").toArrow()
            rows = [unpacked(m, len(i), d.as_py()) for i, d, m in zip(some["ids"], some["dims"], some["matrix"])]
            trials = np.concatenate(rows)[:: max(1, sum(map(len, rows)) // TRIALS)][:TRIALS]
        ids = self.blocks().schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", ids), T.StructField("distance", T.DoubleType())])
        every = np.tile(np.arange(len(self.centroids)), (len(trials), 1))
        found = best_per_query(self._found(pa.array(np.arange(len(trials))), trials, every, k + 1, schema), k + 1).where("rank > 1")
        where = self.blocks().select("list_id", F.explode("ids").alias("id")).join(F.broadcast(found.select("query_id", "id")), "id").select("query_id", "list_id").collect()  # k rows a trial
        if not where:
            return len(self.centroids)
        rank = np.argsort(nearest_lists(trials, self.centroids, len(self.centroids), self.metric), axis=1)
        needed = np.sort([rank[r["query_id"], r["list_id"]] + 1 for r in where])
        return int(needed[min(len(needed), math.ceil(min(1.0, recall + MARGIN) * len(needed))) - 1])

    def search_one(self, query, k: int, nprobe: int | None = None) -> DataFrame:
        """Rows (rank, id, distance) of one query."""
        points = np.array([query], float)
        ids = self.blocks().schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", ids), T.StructField("distance", T.DoubleType())])
        near = nearest_lists(points, self.centroids, min(nprobe or self.nprobe, len(self.centroids)), self.metric)
        return best_per_query(self._found(pa.array([0]), points, near, k, schema), k).select("rank", "id", "distance")

    def rows(self) -> DataFrame:
        """Rows (list_id, id)."""
        return self.blocks().select("list_id", F.explode("ids").alias("id"))


class Sharded(IVFFlat):
    """k-means routing to few shards; a shard of one row is folded into the nearest larger shard."""

    @classmethod
    def build(cls, corpus: DataFrame, metric: str = "cosine", config: ShardConfig = ShardConfig(), seed: int = 42, tune: tuple[int, float] | None = None) -> Sharded:
        rows = corpus.count()
        points = kmeans.sample(corpus, 16_384, seed, rows)
        centroids = kmeans.fit(points, min(config.shards, max(1, rows)), 20, metric, seed)
        placed = kmeans.assign(corpus.select("id", "vector"), centroids, metric)
        large = sorted(r["list_id"] for r in placed.groupBy("list_id").count().where("count > 1").collect())  # at most config.shards rows
        if large and len(large) < len(centroids):
            centroids = centroids[large]
            placed = kmeans.assign(corpus.select("id", "vector"), centroids, metric)
        out = cls(placed, centroids, metric, nprobe=config.nprobe)
        out._write(rows)
        if tune is not None:
            out.nprobe = max(config.nprobe, out.probes_for(*tune, trials=points[:: max(1, len(points) // TRIALS)][:TRIALS]))
            out._commit()
        return out

    def sizes(self) -> DataFrame:
        return kmeans.list_sizes(self.rows())

    def batch_search(self, queries: DataFrame, k: int) -> DataFrame:
        """A batch probes one shard more than single queries do, for its work is shared."""
        return self.search(queries, k, min(len(self.centroids), self.nprobe + 1))
