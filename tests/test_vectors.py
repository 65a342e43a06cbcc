"""Distances, joins, lists, codes and graphs against NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.functions import filters as P
from nearfield.operators import bounded, evaluate, graph, ivf, kmeans, knn, pq
from nearfield.plans.config import ConstructionFailed, CorruptFile, DimensionMismatch, IdAlreadyExists, IVFPQConfig, SearchFailed, ShardConfig
from nearfield.plans.planner import choose, list_count
from nearfield.sources import annbin, reports

METRICS = ("cosine", "l2", "inner_product", "hamming")


def frame(spark, rows, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vector array<double>")


def brute(q, rows, k, metric):
    d = knn.exact_distances(np.asarray(q, float), np.asarray(rows, float), metric)
    order = np.lexsort((np.arange(len(rows)), d))[:k]
    return [int(i) for i in order], d[order]


def adversarial(rng, n=300, dims=16):
    x = rng.normal(size=(n, dims))
    x[: n // 4] = 0
    x[n // 4 : n // 2] = x[n // 2]
    return x * np.array([1e-5, 1, 1e5])[np.arange(n) % 3][:, None]


def recall_of(found, rows, queries, k, metric):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    return np.mean([len(set(brute(q, rows, k, metric)[0]) & got.get(i, set())) / k for i, q in enumerate(queries)])


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("form", ["expression", "kernel", "blocks"])
def test_forms_agree_with_brute_force(spark, metric, form):
    rng = np.random.default_rng(3)
    for rows in (rng.normal(size=(200, 16)), adversarial(rng)):
        queries = np.vstack([rows[:4], np.zeros((1, 16)), rng.normal(size=(2, 16))])
        for k in (1, 24):
            found = knn.knn_join(frame(spark, queries), frame(spark, rows), k, metric, form).orderBy("query_id", "rank").collect()
            for i, q in enumerate(queries):
                ids, d = brute(q, rows, k, metric)
                mine = [r for r in found if r["query_id"] == i]
                assert [r["rank"] for r in mine] == list(range(1, k + 1))
                assert np.allclose([r["distance"] for r in mine], d, rtol=1e-9, atol=1e-9)
                if form != "expression":
                    assert [r["id"] for r in mine] == ids


@pytest.mark.parametrize("metric", METRICS[:3])
def test_bounded_search_is_exact(metric):
    rng = np.random.default_rng(7)
    for rows in (rng.normal(size=(5000, 33)), adversarial(rng, 3000, 33)):
        kept = bounded.derived(rows)
        ids = pa.array(np.arange(len(rows)))
        asked = np.stack([rows[5], rows[-1], np.zeros(33), rng.normal(size=33)])
        for k in (1, 97):
            place, row, d, computed = bounded.bounded_best(asked, rows, kept, ids, k, metric)
            for i, q in enumerate(asked):
                assert row[place == i].tolist() == brute(q, rows, k, metric)[0]
            # The k-th distance that another block gave already leaves as few.
            kth = np.array([d[place == i][-1] for i in range(4)])
            again = bounded.bounded_best(asked, rows, kept, ids, k, metric, kth)
            assert (again[1] == row).all() and again[3] <= computed
    spread = rng.normal(size=(4000, 33))
    assert bounded.bounded_best(spread[:10], spread, bounded.derived(spread), pa.array(np.arange(4000)), 10, metric)[3] < 0.05 * 40_000


def test_bounded_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(700, 12))
    df, asked = frame(spark, rows).repartition(3), frame(spark, rows[:30])
    expected = knn.knn_join(asked, df, 5, "l2", "kernel").orderBy("query_id", "rank").collect()
    index = bounded.Bounded.build(df)
    assert index.search(asked, 5, "l2").orderBy("query_id", "rank").collect() == expected
    for name, value in (("BROADCAST_BYTES", 10), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(bounded, name, value)
    assert index.search(asked, 5, "l2").orderBy("query_id", "rank").collect() == expected
    with pytest.raises(SearchFailed):
        index.search(asked, 5, "hamming")


def test_distance_rules(spark):
    one = spark.range(1).select(
        D.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("zero"),
        D.cosine(F.array().cast("array<double>"), F.array().cast("array<double>")).alias("none"),
        D.l2(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))).alias("l2"),
        D.inner_product(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))).alias("ip"),
        D.hamming(F.array(*map(F.lit, [1, 0, 1, 0, 1, 1, 0, 0])), F.array(*map(F.lit, [0, 0, 1, 1, 1, 0, 0, 1]))).alias("hamming"),
        D.int8_codes(F.array(F.lit(127.0), F.lit(0.5), F.lit(-0.5), F.lit(-127.0))).alias("codes"),
    ).first()
    assert tuple(one) == (1.0, 1.0, 13.0, -13.0, 4.0, [127, 1, -1, -127])
    ids = spark.createDataFrame([("123",), ("v_123",), ("v_1_2",), ("x",), (None,)], "t string").select(D.parse_id("t").alias("i"))
    assert [r["i"] for r in ids.collect()] == [123, 123, None, None, None]


@pytest.mark.parametrize("dims", [8, 64, 70, 130])
def test_bit_words(spark, dims):
    rows = np.random.default_rng(dims).normal(size=(20, dims))
    df = frame(spark, rows)
    words = D.pack_bits(D.binarize("vector"))
    assert df.where(D.unpack_bits(words, dims) != D.binarize("vector")).count() == 0
    other = D.pack_bits(D.binarize(F.array(*[F.lit(float(x)) for x in rows[0]])))
    for r in df.select("id", D.hamming_words(words, other).alias("d")).collect():
        assert r["d"] == ((rows[r["id"]] >= 0) != (rows[0] >= 0)).sum()


def test_single_queries_and_ranges(spark):
    rows = np.random.default_rng(5).normal(size=(100, 8))
    df = frame(spark, rows)
    assert [r["id"] for r in knn.top_k(df, rows[3], 5, "l2").collect()] == brute(rows[3], rows, 5, "l2")[0]
    assert knn.top_k(df, rows[3], 0).count() == 0
    assert [r["id"] for r in knn.range_search(df, rows[3], 0.0, "l2").collect()] == [3]
    assert knn.range_search(df, rows[3], -1.0, "l2").count() == 0
    assert knn.range_search(df, rows[3], -1.0, "inner_product").count() == (rows @ rows[3] >= 1).sum()
    assert knn.range_search(df, rows[3], 100.0, "l2", limit=7).count() == 7
    with pytest.raises(Exception, match="dimensions"):
        knn.knn_join(frame(spark, rows[:2, :4]), df, 3, "l2", "kernel").collect()


def test_planner():
    assert choose("fast", 1000, 1, 8, "l2", False, 4, 16).tier == "ivf"
    assert choose("fast", 100, 1, 8, "l2", False, 4, 16).tier == "expression"
    assert choose("fast", 100_000, 10, 8, "hamming", False).tier == "kernel" and choose("fast", 100_000, 10**7, 8, "hamming", False).tier == "blocks"
    assert choose("fast", 100_000, 10, 8, "l2", True).tier == "kernel"
    assert choose("exact", 10**9, 10**8, 64, "l2", False).tier == "blocks"
    assert [list_count(256, n) for n in (10, 2048, 10**6)] == [10, 32, 2000] and list_count(0, 50) == 1


names, words = st.sampled_from(["a", "b"]), st.sampled_from(["x", "y"])
numbers = st.sampled_from([float("nan"), -1.0, 0.0, 0.1, 2.5])
ints = st.sampled_from([0, 1, 9_000_000_000_000_000_015, 9_000_000_000_000_000_016])
leaves = st.one_of(
    st.just(P.Any()), st.builds(P.Equals, names, words), st.builds(P.In, names, st.frozensets(words)), st.builds(P.GreaterThan, names, numbers), st.builds(P.LessThan, names, numbers),
    st.builds(P.GreaterThanInt, names, ints), st.builds(P.LessThanInt, names, ints),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(P.Not, t), st.lists(t, max_size=3).map(lambda x: P.And(tuple(x))), st.lists(t, max_size=3).map(lambda x: P.Or(tuple(x)))), max_leaves=6)
rows_ = st.tuples(st.dictionaries(names, words), st.dictionaries(names, numbers), st.dictionaries(names, ints))


@settings(max_examples=25, deadline=None)
@given(trees, st.lists(rows_, min_size=1, max_size=5))
def test_predicates_are_two_valued(spark, tree, rows):
    df = spark.createDataFrame([(t or None, f or None, i or None) for t, f, i in rows], "text map<string,string>, floats map<string,float>, ints map<string,bigint>").coalesce(1)
    assert [r[0] for r in df.select(tree.column()).collect()] == [P.evaluate(tree, *r) for r in rows]


def test_filter_builder():
    a, b = P.Equals("a", "x"), P.Equals("b", "y")
    assert P.build() == P.Any() and P.build(P.Any(), a, None) == a and P.build([a, [b]]) == P.And((a, P.And((b,)))) or P.build([a, [b]]) == P.And((a, b))
    assert (a & b) == P.And((a, b)) and (~a) == P.Not(a)


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(1)
    centers = rng.uniform(-1, 1, size=(16, 32))
    rows = centers[np.arange(800) % 16] + rng.uniform(-0.02, 0.02, size=(800, 32))
    return rows, frame(spark, rows).repartition(4).cache()


def test_inverted_lists(spark, clusters):
    rows, df = clusters
    index = ivf.IVFFlat.build(df, "cosine", 16)
    queries = frame(spark, rows[:20])
    scores = [recall_of(index.search(queries, 10, n), rows, rows[:20], 10, "cosine") for n in (1, 4, 16)]
    assert scores[1] >= 0.95 and scores[2] == 1.0 and scores == sorted(scores)
    assert [r["id"] for r in index.search_one(rows[0], 5, 16).collect()] == brute(rows[0], rows, 5, "cosine")[0]


def files_read(df):
    """How many files a scan opened."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def test_lists_on_disk_are_pruned(spark, clusters, tmp_path):
    """Saved with the probes that were measured, loaded in a new session; a batch opens the files of its shelves only."""
    rows, df = clusters
    index = ivf.IVFFlat.build(df, "l2", 16, tune=(5, 0.9))
    assert 1 <= index.nprobe <= 16
    index.save(str(tmp_path / "lists"))
    stored = ivf.IVFFlat.load(spark.newSession(), str(tmp_path / "lists"))
    assert stored.nprobe == index.nprobe and (stored.centroids == index.centroids).all() and stored.metric == "l2"
    near = rows[np.arange(20) * 16]  # all of one cluster
    lists = np.unique(ivf.nearest_lists(near, stored.centroids, 1, "l2"))
    some, every = (files_read(d) for d in (stored._probed(lists), stored.blocks()))
    assert some == len(set(stored.shelf_of[lists])) < every == len(set(stored.shelf_of))
    queries = frame(spark, near)
    plan = stored.search(queries, 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
    assert recall_of(stored.search(queries, 5, 1), rows, near, 5, "l2") >= 0.9
    assert stored.search(queries, 5).orderBy("query_id", "rank").collect() == index.search(queries, 5).orderBy("query_id", "rank").collect()
    with pytest.raises(CorruptFile):
        ivf.IVFFlat.load(spark, str(tmp_path / "none"))


def test_lists_by_a_join_are_the_same(spark, clusters, monkeypatch):
    rows, df = clusters
    monkeypatch.setattr(ivf, "CORPUS_BLOCK", 20)  # lists of several parts
    index = ivf.IVFFlat.build(df, "l2", 8)
    assert index.blocks().groupBy("list_id").count().where("count > 1").count() > 0
    queries = frame(spark, rows[:30])
    direct = index.search(queries, 7, 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(ivf, "QUERY_BLOCK", 4)
    assert index.search(queries, 7, 3).orderBy("query_id", "rank").collect() == direct
    names = df.select((F.col("id").cast("string")).alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    assert ivf.IVFFlat.build(names, "cosine", 8).search(names.limit(3), 1, 8).where("query_id = id").count() == 3


def test_shards(spark, clusters):
    rows, df = clusters
    index = ivf.Sharded.build(df, "l2", ShardConfig(8, 3))
    assert recall_of(index.search(frame(spark, rows[:20]), 10, 3), rows, rows[:20], 10, "l2") >= 0.7
    assert sum(r["size"] for r in index.sizes().collect()) == 800
    # A batch probes one shard more.
    queries = frame(spark, rows[:20])
    assert index.batch_search(queries, 10).orderBy("query_id", "rank").collect() == index.search(queries, 10, 4).orderBy("query_id", "rank").collect()
    assert ivf.Sharded.build(frame(spark, rows[:2]), "l2", ShardConfig(2, 2)).search(frame(spark, rows[:1]), 2, 2).count() == 2


def test_product_quantisation(spark, clusters):
    rows, df = clusters
    quantizer = pq.ProductQuantizer.train(rows, 8, 5)
    codes = quantizer.encode(rows)
    assert codes.shape == (800, 8) and np.corrcoef(quantizer.decode(codes).ravel(), rows.ravel())[0, 1] > 0.99
    assert np.isclose(quantizer.tables(rows[0])[np.arange(8), codes[1]].sum(), ((rows[0] - quantizer.decode(codes[1:2])[0]) ** 2).sum())
    with pytest.raises(ConstructionFailed):
        pq.ProductQuantizer.train(rows[:100], 8)
    with pytest.raises(DimensionMismatch):
        pq.ProductQuantizer.train(rows, 7)


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_ivfpq(spark, clusters, metric, tmp_path):
    rows, df = clusters
    config = IVFPQConfig(lists=16, nprobe=8, metric=metric, iterations=6)
    index = pq.IVFPQ.train(df, config).add(df)
    queries = frame(spark, rows[:20])
    assert recall_of(index.search(queries, 10), rows, rows[:20], 10, metric) > (0.5 if metric == "inner_product" else 0.8)
    sizes = index.sizes()
    assert sizes["vectors"] / sizes["codes"] == 16
    if metric == "l2":
        with pytest.raises(IdAlreadyExists):
            index.add(df.limit(1))
        index.save(str(tmp_path / "index"))
        again = pq.IVFPQ.load(spark, str(tmp_path / "index"))
        assert again.search(queries, 5).orderBy("query_id", "rank").collect() == index.search(queries, 5).orderBy("query_id", "rank").collect()
    tuned = index.tuned(df, 10, 0.9)
    nprobe, shortlist = tuned.settings
    assert nprobe >= 8 and 10 <= shortlist <= 800
    assert recall_of(tuned.search_rescored(queries, df, 10), rows, rows[:20], 10, metric) >= 0.9
    with pytest.raises(SearchFailed):
        index.search_rescored(queries, df, 10)


def test_codes_are_read_in_blocks(spark, clusters, monkeypatch):
    """Sums of table entries over codes in blocks, against one row after the other; many queries meet codes in a join."""
    rows, df = clusters
    quantizer = pq.ProductQuantizer.train(rows, 8, 3)
    codes = quantizer.encode(rows)
    queries = frame(spark, rows[:40])
    coded = pq.encode(df, quantizer).select("id", "codes")
    for metric in ("l2", "inner_product"):
        sums = np.array([quantizer.tables(q, metric)[np.arange(8), codes].sum(1) for q in rows[:40]])
        expected = {(i, round(float(d), 9)) for i in range(40) for d in np.sort(sums[i])[:6]}
        found = pq.adc_search(coded, quantizer, queries, 6, metric).collect()
        assert {(r["query_id"], round(r["distance"], 9)) for r in found} == expected and len(found) == 240
        assert all(abs(sums[r["query_id"], r["id"]] - r["distance"]) < 1e-9 for r in found)
        with monkeypatch.context() as m:
            for name, value in (("BROADCAST_BYTES", 10), ("TABLES", 3), ("GATHERED", 50), ("QUERY_BLOCK", 7), ("CORPUS_BLOCK", 100)):
                m.setattr(pq, name, value)
            again = pq.adc_search(coded, quantizer, queries, 6, metric).collect()
        assert {(r["query_id"], r["rank"], r["id"]) for r in again} == {(r["query_id"], r["rank"], r["id"]) for r in found}


def test_kmeans():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(c, 0.01, size=(50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    centroids = kmeans.fit(points, 3)
    assert sorted(np.round(centroids).astype(int).tolist()) == [[0, 0], [0, 5], [5, 5]]
    assert len(kmeans.fit(points[:1], 5)) == 1
    with pytest.raises(ConstructionFailed):
        kmeans.fit(np.zeros((0, 2)), 1)


def test_graphs(spark, clusters):
    rows, _ = clusters
    rows = rows[:300]
    df = frame(spark, rows).repartition(4)
    exact = graph.exact_graph(df, 8, "l2", "kernel").cache()
    truth = {r["src"]: set() for r in exact.collect()}
    for r in exact.collect():
        truth[r["src"]].add(r["dst"])
    found = graph.nn_descent(df, 8, "l2", 8).collect()
    assert np.mean([r["dst"] in truth[r["src"]] for r in found]) > 0.8
    pruned = graph.prune(exact, df, 8, "l2")
    assert 0 < pruned.count() <= exact.count()
    walked = graph.beam_search(frame(spark, rows[:10]), df, exact, 5, 64, "l2", graph.hnsw_layers(df, 4, 2, "l2"))
    assert walked.count() == 50
    repaired = graph.repair(exact, df, df.where("id < 3").select("id"), 8, "l2")
    assert repaired.count() == exact.count()
    with pytest.raises(SearchFailed):
        graph.beam_search(df, df, exact, 5, 2)
    with pytest.raises(ConstructionFailed):
        graph.nn_descent(df, 300)


def test_evaluation(spark):
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 3), (1, 2, 4)], "query_id int, rank int, id int")
    found = spark.createDataFrame([(0, 1, 1), (0, 2, 9), (1, 1, 4), (1, 2, 3)], "query_id int, rank int, id int")
    assert evaluate.recall(found, truth, 2).first()[0] == 0.75
    metrics = evaluate.Metrics()
    for ms in (0.05, 0.05, 3.0):
        metrics.record("search", ms)
    assert metrics.counts == {"search": 3} and metrics.percentile(0.5) == 0.05 and metrics.percentile(0.99) == 3.75
    points = spark.createDataFrame([(1, 0.5, 10.0), (2, 0.6, 9.0), (3, 0.4, 10.0), (4, 0.5, 10.0)], "k int, recall double, qps double")
    assert sorted(r["k"] for r in evaluate.pareto(points).collect()) == [1, 2, 4]
    rng = np.random.default_rng(4)
    many = [(i, float(rng.integers(30)) if i % 50 else None, float(rng.integers(30)) if i % 71 else None) for i in range(600)]
    kept = [i for i, x, y in many if x is None or y is None or not any(a is not None and b is not None and a >= x and b >= y and (a > x or b > y) for _, a, b in many)]
    found = evaluate.pareto(spark.createDataFrame(many, "k int, recall double, qps double").repartition(3))
    assert sorted(r["k"] for r in found.collect()) == kept
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert evaluate.pareto(points.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_reports(spark, tmp_path, kind):
    samples = spark.createDataFrame([(float(i),) for i in range(1, 101)], "value double")
    path = str(tmp_path / kind)
    for _ in range(2):  # the second replaces the first
        reports.write(evaluate.latency_stats(samples), path, kind)
    (row,) = (spark.read.option("header", True).option("inferSchema", True).csv(path) if kind == "csv" else spark.read.json(path)).collect()
    assert (row["n"], row["p50"], row["p99"], row["max"]) == (100, 50.0, 99.0, 100.0)


def test_data_sets(spark, tmp_path):
    rows = np.random.default_rng(2).normal(size=(30, 4)).astype("f4")
    truth = np.array([brute(q, rows, 3, "l2")[0] for q in rows[:5]], "u4")
    path = str(tmp_path / "set.annbin")
    annbin.save(path, rows, rows[:5], truth, "l2")
    data = annbin.load(spark, path)
    assert data["train"].count() == 30 and np.allclose(data["train"].where("id = 7").first()["vector"], rows[7])
    found = knn.knn_join(data["test"], data["train"], 3, "l2", "kernel")
    assert evaluate.recall(found, data["truth"], 3).first()[0] == 1.0
    raw = open(path, "rb").read()
    for broken in (b"XXXX" + raw[4:], raw[:-1], raw[:10]):
        with pytest.raises(Exception, match="data set|length|shorter"):
            annbin.parse(broken)
    assert annbin.clustered(spark, 20, 4, 5).count() == 20
