"""A k-NN graph that rows can be inserted into, as a folder of vectors, edges and numbered manifests.

Edges are a base and deltas. A delta holds the whole new lists of the nodes that an insertion touched; of a node the list in the
newest folder counts. An insertion writes its vectors and its delta, then one manifest that names both, so it is there whole or not at
all, and older manifests still read what they name. After every `interval` inserted rows their surroundings are repaired.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import graph
from nearfield.operators.knn import knn_join
from nearfield.plans.config import DimensionMismatch, IdAlreadyExists, IndexEmpty
from nearfield.runtime import materialize, scratch, work_path
from nearfield.sources import store

DELTAS = 8  # folders of edges from which on they are written as one


class GraphIndex:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self._state = spark, path, state

    @classmethod
    def build(cls, corpus: DataFrame, degree: int, metric: str = "cosine", interval: int = 100, path: str | None = None) -> GraphIndex:
        """The exact graph of the corpus (id, vector). interval: 0 repairs only when asked to."""
        spark = corpus.sparkSession
        kind = corpus.schema["id"].dataType.simpleString()
        state = {"id_type": kind, "degree": degree, "metric": metric, "interval": interval, "dims": None, "vectors": [], "edges": [], "pending": [], "waiting": 0, "repairs": 0}
        out = cls(spark, path or work_path(spark, "graph"), state)
        rows = corpus.select("id", F.col("vector").cast("array<double>").alias("vector"))
        folder = out._written(rows, "vectors")
        held = spark.read.parquet(f"{out.path}/{folder}")
        edges = out._written(graph.exact_graph(held, degree, metric).select("src", "slot", "dst", "distance"), "edges")
        out._commit(vectors=[folder], edges=[edges], dims=held.agg(F.max(F.size("vector"))).first()[0])
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        if not store.manifests(spark, path):
            raise IndexEmpty(f"{path} has no state")
        return cls(spark, path, store.newest(spark, path))

    def _written(self, df: DataFrame, name: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, **changes) -> None:
        state = {k: v for k, v in (self._state | changes).items() if k not in ("format", "version", "written")}
        number = store.commit(self.spark, self.path, state, self._state.get("version", 0))
        self._state = state | {"version": number}

    @property
    def degree(self) -> int:
        return self._state["degree"]

    @property
    def repairs(self) -> int:
        return self._state["repairs"]

    @property
    def waiting(self) -> int:
        """Rows inserted since the last repair."""
        return self._state["waiting"]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self._state['id_type']}, vector array<double>").parquet(*[f"{self.path}/{f}" for f in self._state["vectors"]])

    def edges(self) -> DataFrame:
        """Rows (src, slot, dst, distance): each node's newest list."""
        kind = self._state["id_type"]
        parts = [self.spark.read.schema(f"src {kind}, slot int, dst {kind}, distance double").parquet(f"{self.path}/{f}").withColumn("version", F.lit(i)) for i, f in enumerate(self._state["edges"])]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        if len(parts) == 1:
            return whole.drop("version")
        # Lists that a later folder replaces; the base is not shuffled for its newest lists, only matched against them.
        out, later = parts[-1], parts[-1].select("src").distinct()
        for p in reversed(parts[:-1]):
            out = out.unionByName(p.join(later, "src", "left_anti"))
            later = later.unionByName(p.select("src").distinct())
        return out.select("src", "slot", "dst", "distance")

    def insert(self, records: DataFrame) -> None:
        """Adds rows (id, vector) and links them: each gets its nearest nodes, old or new, and where it is nearer to one of these than
        the worst neighbour there, it takes that one's place. All rows or none."""
        new = records.select("id", F.col("vector").cast("array<double>").alias("vector"))
        n, low, high = new.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if not n:
            return
        if low != self._state["dims"] or high != self._state["dims"]:
            raise DimensionMismatch(self._state["dims"], low if low != self._state["dims"] else high)
        known = new.select("id").unionByName(self.rows().select("id").join(new.select("id"), "id", "left_semi"))
        twice = known.groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise IdAlreadyExists(str(twice[0]["id"]))
        folder = self._written(new, "vectors")
        added = self.spark.read.parquet(f"{self.path}/{folder}")
        with scratch(self.spark):
            near = knn_join(added, self.rows().unionByName(added), self.degree + 1, self._state["metric"]).where("query_id <> id")
            found = materialize(graph._nearest(near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance"), self.degree).drop("slot"), "near")
            delta = self._written(graph.link(self.edges(), found, self.degree), "edges")
        self._commit(vectors=[*self._state["vectors"], folder], edges=[*self._state["edges"], delta], pending=[*self._state["pending"], folder], waiting=self.waiting + n)
        if self._state["interval"] and self.waiting >= self._state["interval"]:
            self.repair()
        elif len(self._state["edges"]) > DELTAS:
            self._commit(edges=[self._written(self.edges(), "edges")])

    def repair(self, **settings) -> None:
        """Repairs the surroundings of all rows inserted since the last repair. If it fails, they stay to be repaired."""
        if not self._state["pending"]:
            return
        changed = self.spark.read.schema(f"id {self._state['id_type']}").parquet(*[f"{self.path}/{f}" for f in self._state["pending"]])
        with scratch(self.spark):
            found = graph.repair(self.edges(), self.rows(), changed, self.degree, self._state["metric"], **settings)
            folder = self._written(found, "edges")
        self._commit(edges=[folder], pending=[], waiting=0, repairs=self.repairs + 1)

    def search(self, queries: DataFrame, k: int, ef: int = 64, entries: int = 16) -> DataFrame:
        return graph.beam_search(queries, self.rows(), self.edges(), k, ef, self._state["metric"], entries=entries)
