"""Streaming ingest: Structured Streaming batches are appended to a delta, which merges into the base.

State is a folder: tables in folders of their own, and numbered manifests that name those in use and the last
batch. A batch writes its rows, then commits a manifest, so a driver that starts anew on the folder goes on after the
last batch, whatever Structured Streaming's checkpoint replays. A batch appends its own rows only. Every id ever
seen, deleted or not, stays taken. Searches read base and delta, so what a batch wrote is visible at once.

Several writers may be at work: each makes its changes from the newest manifest and commits only if it still is the newest, else it
looks again. A merge that lost against insertions keeps what it wrote; the rows that came meanwhile are the new delta. Folders that no
recent manifest names are deleted. An error of a merge that a batch set off is kept in the manifest, and all later calls raise it
until it is cleared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.functions.filters import Filter
from nearfield.operators import knn
from nearfield.operators.index import META, upsert
from nearfield.plans.config import DimensionMismatch, IdAlreadyExists, IdNotFound, IndexConfig, IndexEmpty, StreamConfig, StreamFailed
from nearfield.runtime import work_path
from nearfield.sources import store

#: Manifests that stay, and with them the folders that they name, for readers that began before the newest.
KEPT = 3


class StreamIndex:
    """On a folder that has a state already, that state with its configurations is taken up. Without path, the folder is a
    work folder of this session."""

    def __init__(self, spark: SparkSession, id_type: str = "string", index: IndexConfig = IndexConfig(), config: StreamConfig = StreamConfig(), path: str | None = None):
        self.spark, self.path = spark, path or work_path(spark, "stream")
        if store.manifests(spark, self.path):
            self._state = store.newest(spark, self.path)
        else:
            self._state = {"id_type": id_type, "index": index.to_json(), "stream": config.to_json(), "dims": None, "last_batch": -1, "merges": 0, "base": [], "delta": [], "tombstones": [], "metadata": [], "error": None}
        self.index, self.config = IndexConfig.from_json(self._state["index"]), StreamConfig.from_json(self._state["stream"])

    @property
    def dims(self) -> int | None:
        return self._state["dims"]

    @property
    def last_batch(self) -> int:
        return self._state["last_batch"]

    @property
    def merges(self) -> int:
        return self._state["merges"]

    def _table(self, name: str) -> DataFrame:
        kind = self._state["id_type"]
        schema = {"base": f"id {kind}, vector array<float>, batch long", "delta": f"id {kind}, vector array<float>, batch long", "tombstones": f"id {kind}", "metadata": f"id {kind}, text {META[0]}, floats {META[1]}, ints {META[2]}"}[name]
        folders = [f"{self.path}/{f}" for f in self._state[name]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    base = property(lambda self: self._table("base"))
    delta = property(lambda self: self._table("delta"))
    tombstones = property(lambda self: self._table("tombstones"))
    metadata = property(lambda self: self._table("metadata"))

    def _written(self, df: DataFrame, name: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def refresh(self) -> None:
        """Takes up what other writers have committed."""
        if store.manifests(self.spark, self.path):
            self._state = store.newest(self.spark, self.path)

    def _checked(self) -> None:
        self.refresh()
        if self._state.get("error"):
            raise StreamFailed(self._state["error"])

    def clear_error(self) -> None:
        self._change(lambda state: {"error": None})

    def _commit(self, **changes) -> None:
        """One change made from the state at hand; another writer's commit since then is a Conflict."""
        state = self._state | changes
        number = store.commit(self.spark, self.path, {k: v for k, v in state.items() if k not in ("format", "version", "written")}, self._state.get("version", 0))
        self._state = state | {"version": number}
        store.forget(self.spark, self.path, KEPT)

    def _change(self, change) -> None:
        """Commits what change makes of the newest state, which it may have to do again. None: there is nothing to change."""
        while True:
            changes = change(self._state)
            if changes is None:
                return
            try:
                return self._commit(**changes)
            except store.Conflict:
                self.refresh()

    def insert(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Adds a batch (id, vector). A batch id that was seen is passed over, so replays change nothing.
        Ids that are taken, or twice in the batch, raise; without strict the first row stays."""
        batch = batch.select("id", F.col("vector").cast("array<float>").alias("vector"))
        n, low, high = batch.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        while True:
            self._checked()
            if batch_id is not None and batch_id <= self.last_batch:
                return
            number = batch_id if batch_id is not None else self.last_batch + 1
            try:
                if not n:
                    return self._commit(last_batch=number)
                dims = self.dims or low
                if low != dims or high != dims:
                    raise DimensionMismatch(dims, low if low != dims else high)
                known = self.base.select("id").unionByName(self.delta.select("id")).unionByName(self.tombstones)
                fresh = batch.join(known, "id", "left_anti").groupBy("id").agg(F.min("vector").alias("vector"))
                folder = self._written(fresh.withColumn("batch", F.lit(number).cast("long")), "delta")
                if self.config.strict and self.spark.read.parquet(f"{self.path}/{folder}").count() != n:
                    raise IdAlreadyExists("an id was seen before, or is there twice")
                self._commit(delta=[*self._state["delta"], folder], last_batch=number, dims=dims)
                break
            except store.Conflict:  # ids that came meanwhile are known the next time
                continue
        if self.delta_count() >= self.config.delta_capacity:
            try:
                self.merge()
            except Exception as error:
                self._change(lambda state, e=error: {"error": f"merge failed: {e}"[:1000]})
                raise

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Ingests a streaming DataFrame (id, vector). An error ends the query and shows in its exception()."""
        return stream.writeStream.foreachBatch(self.insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def delta_count(self) -> int:
        return knn.live(self.delta, self.tombstones).count()

    def merge(self) -> None:
        """The delta's rows become base rows, deleted ones go; their ids stay in the tombstones, which become one folder. Rows and
        deletions that come while the merge writes are kept beside what it wrote."""
        self._checked()
        old = self._state
        folder = self._written(knn.live(self.base.unionByName(self.delta), self.tombstones), "base")
        dead = [self._written(self.tombstones, "tombstones")] if len(old["tombstones"]) > 1 else old["tombstones"]

        def change(state: dict) -> dict | None:
            if state["base"] != old["base"] or any(d not in state["delta"] for d in old["delta"]):
                return None  # another merge was faster, and has these rows
            return {"base": [folder], "delta": [d for d in state["delta"] if d not in old["delta"]], "merges": state["merges"] + 1, "tombstones": [*dead, *(t for t in state["tombstones"] if t not in old["tombstones"])]}

        self._change(change)

    def flush(self) -> None:
        self._checked()
        if self._state["delta"]:
            self.merge()

    def delete(self, key) -> None:
        """Unknown or deleted ids are an error."""
        self.delete_all(self.spark.createDataFrame([(key,)], f"id {self._state['id_type']}"))

    def delete_all(self, ids: DataFrame) -> None:
        """Deletes all rows of ids (id) or none; the same id twice is one."""
        while True:
            self._checked()
            missing = ids.select("id").join(self.rows().select("id"), "id", "left_anti").limit(1).collect()
            if missing:
                raise IdNotFound(str(missing[0]["id"]))
            folder = self._written(ids.select("id").distinct(), "tombstones")
            metadata = [self._written(self.metadata.join(ids.select("id"), "id", "left_anti"), "metadata")] if self._state["metadata"] else []
            try:
                return self._commit(tombstones=[*self._state["tombstones"], folder], metadata=metadata)
            except store.Conflict:
                continue

    def set_metadata(self, values: DataFrame) -> None:
        """One value a name, whatever its type: a name set as text is gone from the numbers, and so on."""
        while True:
            self._checked()
            missing = values.join(self.rows().select("id"), "id", "left_anti").limit(1).collect()
            if missing:
                raise IdNotFound(str(missing[0]["id"]))
            names = values.select("id", F.concat(*[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("text", "floats", "ints")]).alias("_set"))
            old = self.metadata.join(names, "id", "left")
            kept = [F.when(F.col("_set").isNull(), F.col(c)).otherwise(F.map_filter(c, lambda k, v: ~F.array_contains("_set", k))).alias(c) for c in ("text", "floats", "ints")]
            try:
                return self._commit(metadata=[self._written(upsert(old.select("id", *kept), values), "metadata")])
            except store.Conflict:
                continue

    def rows(self, where: Filter | None = None) -> DataFrame:
        live = knn.live(self.base.unionByName(self.delta), self.tombstones)
        return live if where is None else live.join(self.metadata, "id", "left").where(where.column())

    def count(self) -> int:
        return self.rows().count()

    def search(self, query, k: int, where: Filter | None = None) -> DataFrame:
        self._checked()
        return knn.top_k(self.rows(where), query, k, self.index.metric)

    def batch_search(self, queries: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
        self._checked()
        return knn.knn_join(queries, self.rows(where).select("id", "vector"), k, self.index.metric)

    def range_search(self, query, radius: float, where: Filter | None = None, limit: int | None = None) -> DataFrame:
        self._checked()
        return knn.range_search(self.rows(where), query, radius, self.index.metric, limit)

    def save(self, path: str) -> int:
        """A copy of the state in another folder."""
        self.flush()
        if not self.base.limit(1).count():
            raise IndexEmpty("nothing has been inserted")
        copy = {n: [f"{n}-{uuid.uuid4().hex}"] for n in ("base", "tombstones", "metadata")}
        for name, (folder,) in copy.items():
            self._table(name).write.parquet(f"{path}/{folder}")
        return store.commit(self.spark, path, {k: v for k, v in self._state.items() if k not in ("format", "version", "written")} | copy)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StreamIndex:
        """The state of a folder, which goes on from there."""
        if not store.manifests(spark, path):
            raise IndexEmpty(f"{path} has no state")
        return cls(spark, path=path)
