"""The index life cycle: unbuilt, ready, read-only. All states are immutable DataFrames underneath.

Tables: vectors (id, vector, seq), tombstones (id) and metadata (id, text, floats, ints).
Changes give new DataFrames; nothing is rewritten before save() or compact().
"""

from __future__ import annotations

import dataclasses
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.distance import binarize
from nearfield.functions.filters import Any, Filter
from nearfield.operators import graph, knn
from nearfield.operators.evaluate import Metrics
from nearfield.operators.ivf import IVFFlat
from nearfield.plans.config import ConstructionFailed, DimensionMismatch, IdAlreadyExists, IdNotFound, IndexCapacityExceeded, IndexConfig, IndexEmpty, SearchFailed
from nearfield.plans.planner import choose
from nearfield.runtime import materialize
from nearfield.sources import store

META = "map<string,string>", "map<string,float>", "map<string,bigint>"


def validate(records: DataFrame, config: IndexConfig) -> int:
    """The vectors' length. One aggregation checks all rows."""
    size = F.size("vector")
    bad = F.col("id").isNull() | F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull())
    n, ids, low, high, broken = records.agg(F.count("*"), F.countDistinct("id"), F.min(size), F.max(size), F.count(F.when(bad, 1))).first()
    if n == 0:
        raise ConstructionFailed("no rows")
    if broken:
        raise ConstructionFailed("null ids, vectors or components")
    if low != high or low == 0:
        raise DimensionMismatch(high, low)
    if ids != n:
        raise IdAlreadyExists("an id is there twice")
    if config.codec == "binary" and high % 8:
        raise ConstructionFailed("bits are packed by eight: the length must be a multiple")
    if config.max_rows is not None and n > config.max_rows:
        raise IndexCapacityExceeded(str(n))
    return high


def float16(df: DataFrame) -> DataFrame:
    """Rounds the components to 16-bit floats."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("vector")
            column = batch.column(at)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
            sizes = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.withColumn("vector", F.col("vector").cast("array<float>")).schema)


def coded(df: DataFrame, codec: str) -> DataFrame:
    if codec == "float16":
        return float16(df)
    return df.withColumn("vector", binarize("vector").cast("array<float>")) if codec == "binary" else df.withColumn("vector", F.col("vector").cast("array<float>"))


class UnbuiltIndex:
    def __init__(self, config: IndexConfig = IndexConfig()):
        self.config = config

    def build(self, records: DataFrame) -> ReadyIndex:
        """records: (id, vector), and optionally the metadata maps text, floats and ints."""
        dims = validate(records, self.config)
        spark = records.sparkSession
        vectors = materialize(coded(records.select("id", "vector"), self.config.codec).withColumn("seq", F.lit(0).cast("long")), "vectors")
        kind = records.schema["id"].dataType.simpleString()
        metadata = records.select("id", *[F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in zip(("text", "floats", "ints"), META)])
        return ReadyIndex(self.config, dims, vectors, spark.createDataFrame([], f"id {kind}"), metadata)

    def load(self, spark: SparkSession, path: str) -> ReadyIndex:
        return ReadyIndex._from(*store.load(spark, path, "memory"))

    def load_read_only(self, spark: SparkSession, path: str, mode: str = "lazy") -> ReadOnlyIndex:
        return ReadOnlyIndex._from(*store.load(spark, path, mode))


class ReadOnlyIndex:
    def __init__(self, config: IndexConfig, dims: int, vectors: DataFrame, tombstones: DataFrame, metadata: DataFrame):
        self.config, self.dims = config, dims
        self.vectors, self.tombstones, self.metadata = vectors, tombstones, metadata
        self.metrics = Metrics()
        self._ivf: IVFFlat | None = None

    @classmethod
    def _from(cls, tables: dict[str, DataFrame], config: dict):
        return cls(IndexConfig.from_json(config["index"]), config["dims"], tables["vectors"], tables["tombstones"], tables["metadata"])

    def live(self) -> DataFrame:
        return knn.live(self.vectors, self.tombstones)

    def count(self) -> int:
        return self.live().count()

    def _rows(self, where: Filter | None) -> DataFrame:
        rows = self.live()
        if where is None or isinstance(where, Any):
            return rows
        return rows.join(self.metadata, "id", "left").where(where.column())

    def _metric(self, metric: str | None) -> str:
        metric = metric or self.config.metric
        if metric == "hamming" and self.config.codec != "binary":
            raise SearchFailed("hamming needs the binary codec")
        return metric

    def _coded(self, queries: DataFrame) -> DataFrame:
        # Bits are stored as 0 and 1; hamming looks at signs, so both sides are moved by a half.
        if self.config.codec != "binary":
            return queries
        return queries.withColumn("vector", F.transform(binarize("vector"), lambda b: b - 0.5))

    def _stored(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("vector", F.transform("vector", lambda b: b.cast("double") - 0.5)) if self.config.codec == "binary" else rows

    def batch_search(self, queries: DataFrame, k: int, where: Filter | None = None, metric: str | None = None, mode: str | None = None, nprobe: int | None = None) -> DataFrame:
        """Rows (query_id, rank, id, distance). queries: (id, vector). The predicate holds before ranks are given."""
        metric, began = self._metric(metric), time.perf_counter()
        n, low, high = queries.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if n and (low != self.dims or high != self.dims):
            raise DimensionMismatch(self.dims, low if low != self.dims else high)
        rows, nprobe = self._stored(self._rows(where)).select("id", "vector"), nprobe or self.config.ivf_nprobe
        total = self.vectors.count()
        from nearfield.plans.planner import list_count

        plan = choose(mode or self.config.search_mode, total, n, self.dims, metric, where is not None, nprobe, list_count(self.config.ivf_lists, total))
        if k > 0 and plan.tier == "ivf":
            if self._ivf is None or self._ivf.metric != metric:
                self._ivf = IVFFlat.build(rows, metric, self.config.ivf_lists)
            out = self._ivf.search(self._coded(queries), k, nprobe)
        else:
            out = knn.knn_join(self._coded(queries), rows, k, metric, None if plan.tier == "ivf" else plan.tier)
        self.metrics.record("search", (time.perf_counter() - began) * 1000, n)
        return out

    def search(self, query, k: int, where: Filter | None = None, metric: str | None = None) -> DataFrame:
        """Rows (rank, id, distance) for one query."""
        metric = self._metric(metric)
        if len(query) != self.dims:
            raise DimensionMismatch(self.dims, len(query))
        point = [(x >= 0) - 0.5 for x in query] if self.config.codec == "binary" else query
        return knn.top_k(self._stored(self._rows(where)), point, k, metric)

    def range_search(self, query, radius: float, limit: int | None = 1000, where: Filter | None = None, metric: str | None = None) -> DataFrame:
        metric = self._metric(metric)
        if len(query) != self.dims:
            raise DimensionMismatch(self.dims, len(query))
        point = [(x >= 0) - 0.5 for x in query] if self.config.codec == "binary" else query
        return knn.range_search(self._stored(self._rows(where)), point, radius, metric, limit)

    def save(self, path: str) -> int:
        tables = {"vectors": self.vectors, "tombstones": self.tombstones, "metadata": self.metadata}
        return store.save(path, tables, {"index": self.config.to_json(), "dims": self.dims})

    def knn_graph(self, exact: bool = True) -> DataFrame:
        rows = self._stored(self.live()).select("id", "vector")
        if exact:
            return graph.exact_graph(rows, self.config.degree, self.config.metric)
        return graph.nn_descent(rows, self.config.degree, self.config.metric, self.config.max_iterations, self.config.convergence)


class ReadyIndex(ReadOnlyIndex):
    """Each change returns a new index; the old one stays as it was."""

    def _with(self, **changes) -> ReadyIndex:
        parts = {"config": self.config, "dims": self.dims, "vectors": self.vectors, "tombstones": self.tombstones, "metadata": self.metadata}
        new = type(self)(**(parts | changes))
        new.metrics = self.metrics
        return new

    def read_only(self) -> ReadOnlyIndex:
        return ReadOnlyIndex(self.config, self.dims, self.vectors, self.tombstones, self.metadata)

    def batch_insert(self, records: DataFrame) -> ReadyIndex:
        """All rows or none. An id that is there, deleted but not yet compacted, or twice in records is an error."""
        dims = validate(records, dataclasses.replace(self.config, max_rows=None))
        if dims != self.dims:
            raise DimensionMismatch(self.dims, dims)
        clash = records.join(self.vectors.select("id"), "id", "left_semi").select("id").limit(1).collect()
        if clash:
            raise IdAlreadyExists(str(clash[0]["id"]))
        if self.config.max_rows is not None and self.vectors.count() + records.count() > self.config.max_rows:
            raise IndexCapacityExceeded(str(self.config.max_rows))
        last = self.vectors.agg(F.max("seq")).first()[0] or 0
        new = coded(records.select("id", "vector"), self.config.codec).withColumn("seq", F.lit(last + 1).cast("long"))
        self.metrics.record("insert", n=1)
        vectors = self.vectors.unionByName(materialize(new, "vectors"))  # the new rows only are written
        metadata = records.select("id", *[F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in zip(("text", "floats", "ints"), META)])
        return self._with(vectors=vectors, metadata=self.metadata.unionByName(metadata))

    def insert(self, key, vector) -> ReadyIndex:
        spark = self.vectors.sparkSession
        kind = self.vectors.schema["id"].dataType.simpleString()
        return self.batch_insert(spark.createDataFrame([(key, [float(x) for x in vector])], f"id {kind}, vector array<float>"))

    def delete(self, ids: DataFrame) -> ReadyIndex:
        """ids: (id). Unknown ids are an error, deleting twice is none."""
        missing = ids.join(self.vectors.select("id"), "id", "left_anti").limit(1).collect()
        if missing:
            raise IdNotFound(str(missing[0]["id"]))
        self.metrics.record("delete", n=1)
        tombstones = materialize(self.tombstones.unionByName(ids.select("id")).distinct(), "tombstones")
        return self._with(tombstones=tombstones, metadata=self.metadata.join(ids.select("id"), "id", "left_anti"))

    def undelete(self, ids: DataFrame) -> ReadyIndex:
        return self._with(tombstones=self.tombstones.join(ids.select("id"), "id", "left_anti"))

    def compact(self) -> ReadyIndex:
        """Rewrites the live rows; their ids may then be used again. Without deletions nothing happens."""
        if self.tombstones.limit(1).count() == 0:
            return self
        live = materialize(self.live(), "vectors")
        if live.limit(1).count() == 0:
            raise ConstructionFailed("all rows are deleted")
        return self._with(vectors=live, tombstones=self.tombstones.limit(0))

    def set_metadata(self, values: DataFrame) -> ReadyIndex:
        """values: (id, text, floats, ints), maps of what to set; a later value replaces an earlier one."""
        missing = values.join(self.live().select("id"), "id", "left_anti").limit(1).collect()
        if missing:
            raise IdNotFound(str(missing[0]["id"]))
        return self._with(metadata=materialize(upsert(self.metadata, values), "metadata"))


def upsert(metadata: DataFrame, values: DataFrame) -> DataFrame:
    """Sets the maps' entries of values over those of metadata; other entries stay."""
    new = values.select("id", *[F.col(c).alias(f"_{c}") for c in ("text", "floats", "ints")])
    both = metadata.join(new, "id", "full_outer")

    def merged(name: str, kind: str):
        old, set_ = F.coalesce(name, F.map_from_arrays(F.array(), F.array()).cast(kind)), F.coalesce(f"_{name}", F.map_from_arrays(F.array(), F.array()).cast(kind))
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(set_, k)), set_)

    return both.select("id", *[merged(n, k).alias(n) for n, k in zip(("text", "floats", "ints"), META)])
