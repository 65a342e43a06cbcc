"""Life cycle, snapshots and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.filters import Equals, GreaterThan
from nearfield.operators.index import IndexConfig, ReadOnlyIndex, UnbuiltIndex
from nearfield.plans.config import ConstructionFailed, CorruptFile, DimensionMismatch, IdAlreadyExists, IdNotFound, IndexCapacityExceeded, IndexEmpty, SearchFailed, StreamConfig, StreamFailed
from nearfield.sources import store
from nearfield.streaming.stream import StreamIndex

SCHEMA = "id string, vector array<float>"


def records(spark, rows, first=0):
    return spark.createDataFrame([(f"v{i + first}", [float(x) for x in r]) for i, r in enumerate(rows)], SCHEMA)


def nearest(rows, q, k, names, gone=()):
    d = ((rows - q) ** 2).sum(1)
    return [names[i] for i in sorted((i for i in range(len(rows)) if names[i] not in gone), key=lambda i: (d[i], names[i]))[:k]]


def test_life_cycle(spark, tmp_path):
    rows = np.random.default_rng(9).normal(size=(140, 16)).astype("f4")
    names = [f"v{i}" for i in range(140)]
    index = UnbuiltIndex(IndexConfig(metric="l2", degree=4)).build(records(spark, rows[:100]))
    index = index.batch_insert(records(spark, rows[100:139], 100)).insert("v139", rows[139])
    gone = {"v3", "v17", "v120"}
    index = index.delete(spark.createDataFrame([(g,) for g in gone], "id string"))
    index = index.delete(spark.createDataFrame([("v3",)], "id string"))
    expected = nearest(rows, rows[5], 10, names, gone)

    def ids(i):
        return [r["id"] for r in i.search(rows[5], 10).collect()]

    assert index.count() == 137 and ids(index) == expected
    index.save(str(tmp_path / "s"))
    loaded = UnbuiltIndex().load(spark, str(tmp_path / "s"))
    lazy = UnbuiltIndex().load_read_only(spark, str(tmp_path / "s"), "disk")
    assert ids(loaded) == expected and ids(lazy) == expected and isinstance(lazy, ReadOnlyIndex) and not hasattr(lazy, "insert")
    with pytest.raises(IdAlreadyExists):
        loaded.insert("v3", rows[3])
    compacted = loaded.compact()
    assert ids(compacted) == expected and ids(compacted.insert("v3", rows[3])) == nearest(rows, rows[5], 10, names, gone - {"v3"})
    assert compacted.compact() is compacted
    assert compacted.save(str(tmp_path / "s")) == 2 and store.vacuum(spark, str(tmp_path / "s")) == 1
    assert ids(UnbuiltIndex().load(spark, str(tmp_path / "s"))) == expected
    batch = index.batch_search(spark.createDataFrame([("q", [float(x) for x in rows[5]])], SCHEMA), 10).orderBy("rank").collect()
    assert [r["id"] for r in batch] == expected
    near = index.range_search(rows[5], 0.0).collect()
    assert [r["id"] for r in near] == ["v5"]
    assert index.undelete(spark.createDataFrame([("v3",)], "id string")).count() == 138
    assert index.knn_graph().count() == 137 * 4


def test_metadata(spark):
    rows = np.random.default_rng(1).normal(size=(20, 4))
    index = UnbuiltIndex(IndexConfig(metric="l2", degree=4)).build(records(spark, rows))
    values = spark.createDataFrame([(f"v{i}", {"cat": "a" if i < 10 else "b"}, {"score": i / 10} if i % 2 else None, None) for i in range(20)], "id string, text map<string,string>, floats map<string,float>, ints map<string,bigint>")
    index = index.set_metadata(values)
    found = {r["id"] for r in index.search(rows[0], 20, Equals("cat", "a")).collect()}
    assert found == {f"v{i}" for i in range(10)}
    assert {r["id"] for r in index.search(rows[0], 20, ~GreaterThan("score", 0.45)).collect()} == {f"v{i}" for i in range(20) if i % 2 == 0 or i < 5}
    index = index.delete(spark.createDataFrame([("v1",)], "id string"))
    with pytest.raises(IdNotFound):
        index.set_metadata(values.where("id = 'v1'"))
    assert len(index.compact().search(rows[0], 20, Equals("cat", "a")).collect()) == 9


def test_errors(spark):
    build = UnbuiltIndex(IndexConfig(max_rows=3)).build
    with pytest.raises(ConstructionFailed):
        build(spark.createDataFrame([], SCHEMA))
    with pytest.raises(DimensionMismatch):
        build(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], SCHEMA))
    with pytest.raises(IdAlreadyExists):
        build(spark.createDataFrame([("a", [1.0]), ("a", [2.0])], SCHEMA))
    with pytest.raises(ConstructionFailed):
        build(spark.createDataFrame([("a", None), (None, [2.0])], SCHEMA))
    with pytest.raises(IndexCapacityExceeded):
        build(records(spark, np.ones((4, 2))))
    index = build(records(spark, np.ones((3, 2))))
    with pytest.raises(DimensionMismatch):
        index.search([1.0], 1)
    with pytest.raises(SearchFailed):
        index.search([1.0, 1.0], 1, metric="hamming")
    with pytest.raises(IdNotFound):
        index.delete(spark.createDataFrame([("zz",)], "id string"))
    with pytest.raises(ConstructionFailed):
        IndexConfig(metric="hamming")
    with pytest.raises(ConstructionFailed):
        index.delete(index.vectors.select("id")).compact()
    assert IndexConfig.from_json('{"degree": 5, "unknown": 1}') == IndexConfig(degree=5)


@pytest.mark.parametrize("codec", ["binary", "float16"])
def test_codecs(spark, codec):
    rows = np.random.default_rng(4).normal(size=(60, 16))
    index = UnbuiltIndex(IndexConfig(metric="hamming" if codec == "binary" else "l2", codec=codec)).build(records(spark, rows[:50]))
    index = index.batch_insert(records(spark, rows[50:], 50))
    stored = (rows >= 0).astype(float) if codec == "binary" else rows.astype(np.float16).astype(float)
    query = stored[7] if codec == "binary" else rows[7]
    expected = nearest(stored, query, 8, [f"v{i}" for i in range(60)])
    assert [r["id"] for r in index.search(rows[7], 8).collect()] == expected
    batch = index.batch_search(records(spark, rows[7:8]), 8).orderBy("rank").collect()
    assert [r["id"] for r in batch] == expected


def test_snapshots_are_checked(spark, tmp_path):
    path = str(tmp_path / "x")
    with pytest.raises(CorruptFile):
        store.load(spark, path)
    store.save(path, {"t": spark.range(3)}, {})
    assert store.load(spark, path)[0]["t"].count() == 3
    # A writer that died before its manifest leaves the version before.
    spark.range(9).write.parquet(f"{path}/v-dead/t")
    (tmp_path / "x" / "manifest-2.json.0.new").write_text("{")
    assert store.load(spark, path)[0]["t"].count() == 3
    store.commit(spark, path, store.newest(spark, path) | {"tables": {"t": 4}})
    with pytest.raises(CorruptFile):
        store.load(spark, path)
    with pytest.raises(CorruptFile):
        store.write_json(spark, f"{path}/manifest-2.json", {})


def test_stream_survives_a_restart(spark, tmp_path):
    """A new driver object on the folder goes on where the old one ended, and replayed batches change nothing."""
    rows = np.random.default_rng(8).normal(size=(60, 4)).astype("f4")
    source, state, checkpoint = (str(tmp_path / n) for n in ("in", "state", "cp"))

    def ingest():
        index = StreamIndex(spark, config=StreamConfig(delta_capacity=25), index=IndexConfig(metric="l2"), path=state)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        index.start(stream, checkpoint).awaitTermination()
        return index

    for b in range(2):
        records(spark, rows[20 * b : 20 * b + 20], 20 * b).coalesce(1).write.mode("append").parquet(source)
    first = ingest()
    assert (first.count(), first.last_batch, first.merges) == (40, 1, 1)
    first.delete("v3")
    first.set_metadata(spark.createDataFrame([("v5", {"tag": "hot"}, None, None)], first.metadata.schema))
    records(spark, rows[40:], 40).coalesce(1).write.mode("append").parquet(source)
    second = ingest()
    assert (second.count(), second.last_batch) == (59, 2) and second.rows(Equals("tag", "hot")).count() == 1
    # The state is ahead of a checkpoint that was lost: the same batches come again.
    again = StreamIndex(spark, path=state)
    for b in range(3):
        again.insert(records(spark, rows[20 * b : 20 * b + 20], 20 * b), b)
    assert again.count() == 59 and again.config.delta_capacity == 25
    names = [f"v{i}" for i in range(60)]
    assert [r["id"] for r in again.search([float(x) for x in rows[7]], 5).collect()] == nearest(rows, rows[7], 5, names, {"v3"})


def test_stream(spark, tmp_path):
    rows = np.random.default_rng(6).normal(size=(90, 8)).astype("f4")
    names = [f"v{i}" for i in range(90)]
    for b in range(3):
        records(spark, rows[30 * b : 30 * b + 30], 30 * b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = StreamIndex(spark, config=StreamConfig(delta_capacity=60), index=IndexConfig(metric="l2"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert index.count() == 90 and index.merges == 1 and index.delta_count() == 30
    index.insert(records(spark, rows[:1]), batch_id=0)  # a replay changes nothing
    with pytest.raises(IdAlreadyExists):
        index.insert(records(spark, rows[:1]))
    index.delete("v4")
    with pytest.raises(IdNotFound):
        index.delete("v4")
    with pytest.raises(IdAlreadyExists):
        index.insert(records(spark, rows[4:5], 4))
    expected = nearest(rows, rows[5], 5, names, {"v4"})
    ids = lambda: [r["id"] for r in index.search([float(x) for x in rows[5]], 5).collect()]
    assert ids() == expected
    assert [r["id"] for r in index.range_search([float(x) for x in rows[5]], 0.0).collect()] == ["v5"]
    index.set_metadata(spark.createDataFrame([("v5", {"tag": "hot"}, None, None)], index.metadata.schema))
    index.set_metadata(spark.createDataFrame([("v5", None, {"tag": 1.5}, None)], index.metadata.schema))
    assert index.rows(Equals("tag", "hot")).count() == 0 and index.rows(GreaterThan("tag", 1.0)).count() == 1
    index.flush()
    index.flush()
    assert ids() == expected and index.delta_count() == 0
    index.save(str(tmp_path / "saved"))
    again = StreamIndex.load(spark, str(tmp_path / "saved"))
    assert again.count() == 89 and again.rows(GreaterThan("tag", 1.0)).count() == 1
    lax = StreamIndex(spark, config=StreamConfig(strict=False))
    lax.insert(records(spark, rows[:10]))
    lax.insert(records(spark, rows[5:15], 5))
    assert lax.count() == 15
    with pytest.raises(IndexEmpty):
        StreamIndex(spark).save(str(tmp_path / "none"))
    with pytest.raises(DimensionMismatch):
        lax.insert(records(spark, rows[:1, :3], 500))


def folders(path):
    import os

    return [f for f in os.listdir(path) if os.path.isdir(os.path.join(path, f))], [f for f in os.listdir(path) if f.startswith("manifest")]


def test_rows_that_arrive_during_a_merge(spark, tmp_path, monkeypatch):
    """Another writer inserts and deletes while a merge has written its rows but not committed: nothing is lost or comes back."""
    rows = np.random.default_rng(9).normal(size=(60, 4)).astype("f4")
    path = str(tmp_path / "state")
    config = StreamConfig(delta_capacity=1000)
    merging, other = (StreamIndex(spark, config=config, index=IndexConfig(metric="l2"), path=path) for _ in range(2))
    merging.insert(records(spark, rows[:20]), 0)
    merging.delete("v1")
    written = StreamIndex._written

    def interleaved(self, df, name):
        out = written(self, df, name)
        if name == "base" and self is merging:
            other.insert(records(spark, rows[20:30], 20), 1)
            other.delete("v2")
            other.insert(records(spark, rows[30:40], 30), 2)
        return out

    monkeypatch.setattr(StreamIndex, "_written", interleaved)
    merging.merge()
    monkeypatch.setattr(StreamIndex, "_written", written)
    assert (merging.count(), merging.delta_count(), merging.merges, merging.last_batch) == (38, 20, 1, 2)
    assert {r["id"] for r in merging.rows().collect()} == {f"v{i}" for i in range(40)} - {"v1", "v2"}
    # An insertion that loses the race sees the ids that came meanwhile.
    def late(self, df, name):
        out = written(self, df, name)
        if name == "delta" and self is other and other.last_batch == 2:
            merging.insert(records(spark, rows[40:42], 40), 3)
        return out

    monkeypatch.setattr(StreamIndex, "_written", late)
    with pytest.raises(IdAlreadyExists):
        other.insert(records(spark, rows[41:43], 41))
    other.insert(records(spark, rows[43:45], 43))
    monkeypatch.setattr(StreamIndex, "_written", written)
    merging.flush()
    assert merging.count() == 42 and merging.delta_count() == 0
    # Of two merges at once one has all rows.
    merging.insert(records(spark, rows[50:60], 50))
    other.refresh()
    monkeypatch.setattr(StreamIndex, "_written", lambda self, df, name: (written(self, df, name), other.merge() if self is merging and name == "base" else None)[0])
    merging.merge()
    assert merging.count() == 52 and merging.delta_count() == 0


def test_folders_stay_few(spark, tmp_path):
    rows = np.random.default_rng(4).normal(size=(120, 3)).astype("f4")
    path = str(tmp_path / "state")
    index = StreamIndex(spark, config=StreamConfig(delta_capacity=5), index=IndexConfig(metric="l2"), path=path)
    for i in range(20):
        index.insert(records(spark, rows[5 * i : 5 * i + 5], 5 * i).coalesce(1), i)
        if i % 4 == 0:
            index.delete_all(spark.createDataFrame([(f"v{5 * i}",), (f"v{5 * i + 1}",), (f"v{5 * i}",)], "id string"))
    assert index.merges == 20 and index.count() == 90
    kept, manifests = folders(path)
    assert len(kept) <= 10 and len(manifests) == 3
    with pytest.raises(IdNotFound):
        index.delete_all(spark.createDataFrame([("v4",), ("v0",)], "id string"))
    assert index.count() == 90
    assert store.vacuum(spark, path) >= 1 and StreamIndex(spark, path=path).count() == 90


def test_errors_stay_until_cleared(spark, tmp_path, monkeypatch):
    rows = np.random.default_rng(4).normal(size=(30, 3)).astype("f4")
    path = str(tmp_path / "state")
    index = StreamIndex(spark, config=StreamConfig(delta_capacity=10), index=IndexConfig(metric="l2"), path=path)
    with monkeypatch.context() as m:
        m.setattr(StreamIndex, "merge", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.insert(records(spark, rows[:10]), 0)
    again = StreamIndex(spark, path=path)
    for call in (lambda: again.insert(records(spark, rows[10:20], 10), 1), lambda: again.search([0.0] * 3, 2), again.flush, again.merge, lambda: again.delete("v1")):
        with pytest.raises(StreamFailed, match="division"):
            call()
    again.clear_error()
    again.insert(records(spark, rows[10:20], 10), 1)
    assert again.count() == 20 and again.merges == 1


def test_snapshots_with_other_ids_are_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    index = UnbuiltIndex(IndexConfig(metric="l2")).build(records(spark, np.eye(4, dtype="f4")))
    index.save(path)
    tables, config = store.load(spark, path)
    assert store.unmatched(tables).count() == 0
    other = tables["vectors"].withColumn("id", F.concat(F.lit("x"), "id"))
    lost = store.unmatched(tables | {"vectors": other}).collect()
    assert {(r["table"], r["problem"]) for r in lost} == {("metadata", "unknown")} and len(lost) == 4
    # As many rows, and a manifest that says so, but other ids.
    manifest = store.newest(spark, path)
    other.write.parquet(f"{path}/other/vectors")
    for name in ("metadata", "tombstones"):
        tables[name].write.parquet(f"{path}/other/{name}")
    store.commit(spark, path, manifest | {"folder": "other"})
    with pytest.raises(CorruptFile, match="other ids"):
        store.load(spark, path)
    store.commit(spark, path, manifest | {"folder": "other", "ids": {}})
    with pytest.raises(CorruptFile, match="do not match"):
        UnbuiltIndex().load(spark, path)


def test_insertions_write_their_rows_only(spark):
    index = UnbuiltIndex(IndexConfig(metric="l2")).build(records(spark, np.eye(6, dtype="f4")[:3]))
    more = index.batch_insert(records(spark, np.eye(6, dtype="f4")[3:], 3))
    old, new = set(index.vectors.inputFiles()), set(more.vectors.inputFiles())
    assert old < new and more.count() == 6 and index.count() == 3
