"""Named queries over the standard tables, and the same in DuckDB's SQL where SQL can say it.

Vectors are `embeddings`, scaled by 1 + vec_id % 7 so that metrics rank differently.
Distances are rounded to six places for comparison, after ranking.

Every query works on whole tables: all rows are searched, and every row with EVERY asks. Where a model
is fitted or a search is approximate, a query gives its rows, and one named *_recall says whether they hold what they must.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.functions.filters import And, Equals, Filter, GreaterThan, GreaterThanInt, In, LessThan, LessThanInt, Not, Or
from nearfield.operators import bounded, evaluate, graph, ivf, kmeans, knn, pq
from nearfield.operators.graph_index import GraphIndex
from nearfield.operators.index import IndexConfig, UnbuiltIndex, float16, upsert
from nearfield.plans.config import IVFPQConfig, ShardConfig, StreamConfig
from nearfield.runtime import materialize, table, work_path
from nearfield.sources import annbin, store
from nearfield.streaming.stream import StreamIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EVERY = "id % 50 = 0"
RECALL = 0.9  # of the ten nearest, that approximate searches find at least
VECTOR = "list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7))"
V = f"v AS (SELECT vec_id AS id, {VECTOR} AS vector, label, vec_id % 10 = 3 AS dead FROM embeddings WHERE embedding IS NOT NULL)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def _sql_distance(a: str, b: str, metric: str) -> str:
    if metric == "l2":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    if metric == "inner_product":
        return f"-{_dot(a, b)}"
    if metric == "hamming":
        return f"len(list_filter(list_zip({a}, {b}), lambda p: (p[1] >= 0) <> (p[2] >= 0)))::DOUBLE"
    size = f"(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"
    return f"(CASE WHEN {size} < 1e-10 THEN 1.0 ELSE greatest(0.0, 1.0 - {_dot(a, b)} / {size}) END)"


def _ranked(source: str, k: int, extra: str = "") -> str:
    return f"SELECT query_id, rank, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM ({source})) WHERE rank <= {k}{extra}"


def _pairs(metric: str, queries: str = EVERY, rows: str = "true") -> str:
    return f"SELECT q.id AS query_id, c.id AS id, {_sql_distance('c.vector', 'q.vector', metric)} AS d FROM (SELECT * FROM v WHERE {queries}) q, (SELECT * FROM v WHERE {rows}) c"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label) in partitions for all cores at least: a small source is one file."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    vector = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7))
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, "vec_id")
    return rows.select(F.col("vec_id").alias("id"), vector.alias("vector"), "label")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return corpus(spark, sf_dir).where("id = 0").first()["vector"]


def _metadata(rows: DataFrame) -> DataFrame:
    """Some rows lack some columns; some floats are NaN."""
    return rows.withColumns({
        "text": F.when(F.col("id") % 5 != 0, F.create_map(F.lit("cat"), F.concat(F.lit("c"), F.col("label").cast("string")))),
        "floats": F.when(F.col("id") % 4 != 1, F.create_map(F.lit("score"), F.when(F.col("id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 50 / 10.0).cast("float"))),
        "ints": F.when(F.col("id") % 3 != 2, F.create_map(F.lit("ts"), F.lit(9_000_000_000_000_000_000) + F.col("id"))),
    })


META = "m AS (SELECT v.*, CASE WHEN id % 5 <> 0 THEN 'c' || label END AS cat, CASE WHEN id % 4 <> 1 THEN CASE WHEN id % 6 = 0 THEN 'NaN'::FLOAT ELSE (id % 50 / 10.0)::FLOAT END END AS score, CASE WHEN id % 3 <> 2 THEN 9000000000000000000 + id END AS ts FROM v)"


def _single(metric: str, rows: str = "true", k: int = 10) -> str:
    return f"WITH {V}, d AS (SELECT c.id, {_sql_distance('c.vector', 'q.vector', metric)} AS d FROM v c, (SELECT vector FROM v WHERE id = 0) q WHERE {rows}) SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT {k}"


def _register_searches() -> None:
    for metric, short in (("cosine", "cosine"), ("l2", "l2"), ("inner_product", "ip"), ("hamming", "hamming")):
        register(f"knn_{short}", _single(metric))(lambda s, d, m=metric: _rounded(knn.top_k(corpus(s, d), _query(s, d), 10, m)))
        sql = f"WITH {V} {_ranked(_pairs(metric), 10)}"

        def join(s, d, m=metric, form=None):
            rows = corpus(s, d)
            return _rounded(knn.knn_join(rows.where(EVERY), rows, 10, m, form))

        register(f"knn_join_{short}", sql)(join)
        register(f"knn_join_kernel_{short}", sql)(lambda s, d, f=join, m=metric: f(s, d, m, "kernel"))
        register(f"knn_join_blocks_{short}", sql)(lambda s, d, f=join, m=metric: f(s, d, m, "blocks"))
        if metric != "hamming":

            def prefiltered(s, d, m=metric):
                rows = corpus(s, d)
                return _rounded(bounded.knn_join_bounded(rows.where(EVERY), rows, 10, m))

            register(f"knn_join_bounded_{short}", sql)(prefiltered)

        near = {"cosine": 0.8, "l2": 30.0, "inner_product": -1.0, "hamming": 28.0}[metric]
        within = f"WITH {V}, d AS (SELECT c.id, {_sql_distance('c.vector', 'q.vector', metric)} AS d FROM v c, (SELECT vector FROM v WHERE id = 0) q) SELECT id, round(d, 6) AS distance FROM d WHERE d <= {near} ORDER BY d, id"
        register(f"range_{short}", within)(lambda s, d, m=metric, r=near: _rounded(knn.range_search(corpus(s, d), _query(s, d), r, m, None)))
    register("range_limit", _single("l2", "true", 25).replace("row_number() OVER (ORDER BY d, id) AS rank, ", "").replace("FROM d ORDER", "FROM d WHERE d <= 60.0 ORDER"))(lambda s, d: _rounded(knn.range_search(corpus(s, d), _query(s, d), 60.0, "l2", 25)))

    every = f"WITH {V} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank, id, round(d, 6) AS distance FROM ({_pairs('l2')}) WHERE d <= 60.0"
    for name, form in (("range_join", "kernel"), ("range_join_blocks", "blocks")):
        register(name, every)(lambda s, d, f=form: _rounded(knn.range_join(corpus(s, d).where(EVERY), corpus(s, d), 60.0, "l2", None, f)))

    register("deleted_knn", _single("cosine", "NOT c.dead"))(lambda s, d: _rounded(knn.top_k(knn.live(corpus(s, d), corpus(s, d).where("id % 10 = 3")), _query(s, d), 10)))

    @register("post_process", f"WITH {V}, d AS (SELECT c.id, {_sql_distance('c.vector', 'q.vector', 'l2')} AS d, label FROM v c, (SELECT vector FROM v WHERE id = 0) q WHERE NOT c.dead) SELECT 'v_' || id AS name, round(d, 6) AS distance FROM d WHERE label < 5 AND d <= 80.0 AND id % 2 = 0 ORDER BY d, id LIMIT 12")
    def post_process(s, d):
        rows = corpus(s, d)
        found = rows.select("id", "label", D.distance("vector", knn.literal(_query(s, d)), "l2").alias("distance"))
        names = rows.where("id % 2 = 0").select("id", F.concat(F.lit("v_"), F.col("id").cast("string")).alias("name"))
        out = knn.post_process(found, 12, rows.where("id % 10 = 3"), F.col("label") < 5, 80.0, names)
        return _rounded(out.select("name", "distance"))

    @register(f"search_beyond_256", f"WITH {V} {_ranked(_pairs('l2', EVERY, 'NOT dead'), 300)}")
    def beyond(s, d):
        rows = corpus(s, d)
        return _rounded(knn.knn_join(rows.where(EVERY), knn.live(rows, rows.where("id % 10 = 3")), 300, "l2", "kernel"))

    @register("sql_vec_distance", f"WITH {V} SELECT a.id, round({_sql_distance('a.vector', 'b.vector', 'l2')}, 6) AS l2, round({_sql_distance('a.vector', 'b.vector', 'cosine')}, 6) AS cosine, round({_sql_distance('a.vector', 'b.vector', 'inner_product')}, 6) AS ip, {_sql_distance('a.vector', 'b.vector', 'hamming')} AS hamming FROM v a JOIN v b ON b.id = a.id + 1")
    def sql_distance(s, d):
        D.register(s)
        rows = corpus(s, d)
        b = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
        call = lambda m: F.call_function("vec_distance", "vector", "other", F.lit(m))
        return rows.join(b, "id").select("id", F.round(call("l2"), 6).alias("l2"), F.round(call("cosine"), 6).alias("cosine"), F.round(call("inner_product"), 6).alias("ip"), call("hamming").alias("hamming"))


    @register("sql_knn_function", _single("l2"))
    def knn_function(s, d):
        corpus(s, d).createOrReplaceTempView("nearfield_corpus")
        D.register_table_function(s, "nearfield_nearest", "nearfield_corpus")
        query = ", ".join(f"{x!r}D" for x in _query(s, d))
        return _rounded(s.sql(f"SELECT * FROM nearfield_nearest(array({query}), 10, 'l2')"))


def _register_filters() -> None:
    base = 9_000_000_000_000_000_000
    cases: dict[str, tuple[Filter, str]] = {
        "eq": (Equals("cat", "c1"), "coalesce(cat = 'c1', false)"),
        "in": (In("cat", frozenset({"c1", "c4", "c7"})), "coalesce(cat IN ('c1', 'c4', 'c7'), false)"),
        "gt_float": (GreaterThan("score", 2.5), "coalesce(NOT isnan(score) AND score > 2.5::FLOAT, false)"),
        "lt_float": (LessThan("score", 1.0), "coalesce(NOT isnan(score) AND score < 1.0::FLOAT, false)"),
        "gt_float_of_int": (GreaterThan("ts", 8.9e18), "coalesce(ts::FLOAT > 8.9e18::FLOAT, false)"),
        "gt_int": (GreaterThanInt("ts", base + 100), f"coalesce(ts > {base + 100}, false)"),
        "lt_int": (LessThanInt("ts", base + 50), f"coalesce(ts < {base + 50}, false)"),
        "and_or_not": (And((Or((Equals("cat", "c1"), Equals("cat", "c2"))), Not(GreaterThan("score", 3.0)))), "coalesce(cat IN ('c1', 'c2'), false) AND NOT coalesce(NOT isnan(score) AND score > 3.0::FLOAT, false)"),
        "missing_not": (Not(Equals("cat", "c1")), "NOT coalesce(cat = 'c1', false)"),
        "empty": (And((Or(()), And(()))), "false"),
    }
    for name, (predicate, sql) in cases.items():
        query = f"WITH {V}, {META}, d AS (SELECT c.id, {_sql_distance('c.vector', 'q.vector', 'cosine')} AS d FROM m c, (SELECT vector FROM v WHERE id = 0) q WHERE {sql}) SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10"
        register(f"filtered_{name}", query)(lambda s, d, p=predicate: _rounded(knn.top_k(_metadata(corpus(s, d)).where(p.column()), _query(s, d), 10)))

    keep = "coalesce(cat = 'c1', false) OR coalesce(ts < 9000000000000000300, false)"
    @register(f"filtered_knn_join", f"WITH {V}, {META}, w AS (SELECT * FROM m WHERE {keep}), pairs AS (SELECT q.id AS query_id, c.id, {_sql_distance('c.vector', 'q.vector', 'l2')} AS d FROM (SELECT * FROM v WHERE {EVERY}) q, w c) {_ranked('SELECT * FROM pairs', 5)}")
    def filtered_join(s, d):
        rows = _metadata(corpus(s, d))
        predicate = Equals("cat", "c1") | LessThanInt("ts", base + 300)
        return _rounded(knn.knn_join(rows.where(EVERY), rows.where(predicate.column()).select("id", "vector"), 5, "l2", "expression"))

    @register("metadata_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'c' || label END AS cat, CASE WHEN vec_id % 2 = 0 THEN 'x' END AS extra FROM embeddings WHERE embedding IS NOT NULL")
    def metadata_upsert(s, d):
        rows = corpus(s, d).select("id", F.create_map(F.lit("cat"), F.concat(F.lit("c"), F.col("label").cast("string"))).alias("text"), F.lit(None).cast("map<string,float>").alias("floats"), F.lit(None).cast("map<string,bigint>").alias("ints"))
        new = rows.where("id % 2 = 0").select("id", F.create_map(F.lit("cat"), F.lit("new"), F.lit("extra"), F.lit("x")).alias("text"), "floats", "ints")
        get = lambda n: F.try_element_at("text", F.lit(n))
        return upsert(rows, new).select("id", get("cat").alias("cat"), get("extra").alias("extra"))


def _register_expressions() -> None:
    @register("norms", f"WITH {V} SELECT id, round({_dot('vector', 'vector')}, 6) AS norm_sq FROM v")
    def norms(s, d):
        return corpus(s, d).select("id", F.round(D.norm_sq("vector"), 6).alias("norm_sq"))

    @register("binarize_bits", f"WITH {V} SELECT id, array_to_string(list_transform(vector, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END), '') AS bits FROM v")
    def bits(s, d):
        return corpus(s, d).select("id", F.array_join(F.transform(D.binarize("vector"), lambda b: b.cast("string")), "").alias("bits"))

    @register("hamming_packed", f"WITH {V} SELECT a.id, {_sql_distance('a.vector', 'b.vector', 'hamming')} AS distance FROM v a, (SELECT vector FROM v WHERE id = 0) b")
    def packed(s, d):
        query = F.array(*[F.lit(x) for x in _query(s, d)])
        return corpus(s, d).select("id", D.hamming_words(D.pack_bits(D.binarize("vector")), D.pack_bits(D.binarize(query))).alias("distance"))

    @register("bits_round_trip", f"WITH {V} SELECT id, true AS same FROM v")
    def round_trip(s, d):
        return corpus(s, d).select("id", (D.unpack_bits(D.pack_bits(D.binarize("vector")), 64) == D.binarize("vector")).alias("same"))

    step = "(CASE WHEN list_max(list_transform(vector, lambda x: abs(x))) = 0 THEN 1.0 ELSE list_max(list_transform(vector, lambda x: abs(x))) / 127.0 END)"
    @register("int8_codes", f"WITH {V}, u AS (SELECT id, vector, {step} AS step FROM v) SELECT id, round(step, 9) AS step, array_to_string(list_transform(vector, lambda x: greatest(-127, least(127, round(x / step)::INT))), ',') AS codes FROM u")
    def int8(s, d):
        return corpus(s, d).select("id", F.round(D.int8_scale("vector"), 9).alias("step"), F.array_join(F.transform(D.int8_codes("vector"), lambda c: c.cast("string")), ",").alias("codes"))

    @register("sinusoid", "SELECT i AS id, round(list_sum(list_transform(range(0, 16), lambda j: (sin((i * 16 + j) * 0.173) + cos((i * 16 + j) * 0.071))::FLOAT::DOUBLE)), 3) AS total FROM range(0, 200) t(i)")
    def sinusoid(s, d):
        return annbin.sinusoid(s, 200, 16).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))

    @register("parse_ids", "WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'v_' || event_id WHEN 2 THEN 'x' ELSE 'v_' || event_id || '_1' END AS name FROM events) SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id END AS parsed FROM t")
    def parse_ids(s, d):
        e = F.col("event_id")
        name = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, F.concat(F.lit("v_"), e.cast("string"))).when(e % 4 == 2, F.lit("x")).otherwise(F.concat(F.lit("v_"), e.cast("string"), F.lit("_1")))
        return table(s, d, "events").select("event_id", D.parse_id(name).alias("parsed"))

    # A 16-bit float has 11 digits: |x| is rounded to a multiple of 2 ** (e - 10), halves to even; all are multiples of 2 ** -24.
    power = "(CASE WHEN pow(2, floor(log2(abs(x)))) > abs(x) THEN floor(log2(abs(x))) - 1 WHEN pow(2, floor(log2(abs(x))) + 1) <= abs(x) THEN floor(log2(abs(x))) + 1 ELSE floor(log2(abs(x))) END)"
    half_sql = f"CASE WHEN x = 0 THEN 0 ELSE (round_even(x / pow(2, greatest({power}, -14) - 10), 0) * pow(2, greatest({power}, -14) + 14))::BIGINT END"

    @register("float16_round", f"WITH {V} SELECT id, array_to_string(list_transform(vector, lambda y: list_transform([y::FLOAT::DOUBLE], lambda x: {half_sql})[1]), ',') AS units FROM v")
    def half(s, d):
        units = F.transform("vector", lambda x: (x.cast("double") * float(1 << 24)).cast("long").cast("string"))
        return float16(corpus(s, d).withColumn("vector", F.col("vector").cast("array<float>"))).select("id", F.array_join(units, ",").alias("units"))


def _register_lists() -> None:
    mean = "c AS (SELECT label AS list_id, list(x ORDER BY place) AS center FROM (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS place FROM v WHERE label IS NOT NULL) GROUP BY label, place) GROUP BY label)"

    def centers(s, d):
        found = kmeans.centroid_means(corpus(s, d).where("label is not null"), "label").orderBy("label").collect()  # one row a label
        return np.array([r["vector"] for r in found])

    near = f"n AS (SELECT v.id, arg_min(list_id, (round({_sql_distance('vector', 'center', 'l2')}, 9), list_id)) AS list_id FROM v, c GROUP BY v.id)"

    @register("centroid_means", f"WITH {V}, {mean} SELECT list_id AS label, round(list_sum(center), 6) AS total, round({_dot('center', 'center')}, 6) AS norm_sq FROM c")
    def means(s, d):
        found = kmeans.centroid_means(corpus(s, d).where("label is not null"), "label")
        return found.select("label", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(D.norm_sq("vector"), 6).alias("norm_sq"))

    @register("assign_to_centroid", f"WITH {V}, {mean}, {near} SELECT id, list_id FROM n")
    def assigned(s, d):
        return kmeans.assign(corpus(s, d).select("id", "vector"), centers(s, d)).select("id", "list_id")

    @register("list_sizes", f"WITH {V}, {mean}, {near} SELECT list_id, count(*) AS size, coalesce(sum(count(*)) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM n GROUP BY list_id")
    def sizes(s, d):
        return kmeans.list_sizes(kmeans.assign(corpus(s, d).select("id", "vector"), centers(s, d)))

    probe = f"p AS (SELECT query_id, list_id FROM (SELECT v.id AS query_id, list_id, row_number() OVER (PARTITION BY v.id ORDER BY {_sql_distance('center', 'vector', 'l2')}, list_id) AS r FROM v, c WHERE v.{EVERY}) WHERE r <= 3)"
    pairs = f"SELECT p.query_id, v.id, {_sql_distance('v.vector', 'q.vector', 'l2')} AS d FROM p JOIN n USING (list_id) JOIN v ON v.id = n.id JOIN v q ON q.id = p.query_id"

    @register("ivf_probe_l2", f"WITH {V}, {mean}, {near}, {probe} {_ranked(pairs, 10)}")
    def probe_l2(s, d):
        rows, c = corpus(s, d).select("id", "vector"), centers(s, d)
        return _rounded(ivf.IVFFlat(kmeans.assign(rows, c), c, "l2").search(rows.where(EVERY), 10, 3))

    # The same lists as a folder: written, read by another object, and probed there.
    @register("ivf_loaded", f"WITH {V}, {mean}, {near}, {probe} {_ranked(pairs, 10)}")
    def loaded(s, d):
        rows, c = corpus(s, d).select("id", "vector"), centers(s, d)
        path = work_path(s, "lists")
        ivf.IVFFlat(kmeans.assign(rows, c), c, "l2", nprobe=3).save(path)
        return _rounded(ivf.IVFFlat.load(s, path).search(rows.where(EVERY), 10))

    @register("shard_route", f"WITH {V}, {mean}, {probe} SELECT query_id, list_id FROM p")
    def route(s, d):
        return ivf.probes(corpus(s, d).where(EVERY), centers(s, d), 3, "l2").select("query_id", "list_id")

    @register("residuals", f"WITH {V}, {mean} SELECT id, round(list_sum(list_transform(list_zip(vector, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS size FROM v JOIN c ON v.label = c.list_id")
    def residuals(s, d):
        rows = corpus(s, d)
        c = kmeans.centroid_means(rows.where("label is not null"), "label").withColumnRenamed("vector", "center")
        return rows.join(c, "label").select("id", F.round(D.norm_sq(D.residual("vector", "center")), 6).alias("size"))

    @register(f"ivf_exact_when_all_probed", f"WITH {V} {_ranked(_pairs('cosine', EVERY), 10)}")
    def all_probed(s, d):
        rows = corpus(s, d).select("id", "vector")
        index = ivf.IVFFlat.build(rows, "cosine", 8)
        return _rounded(index.search(rows.where(EVERY), 10, 8))

    @register("ivf_flat")
    def ivf_flat(s, d):
        rows = corpus(s, d).select("id", "vector")
        return ivf.IVFFlat.build(rows, "cosine", tune=(10, RECALL)).search(rows.where(EVERY), 10)

    @register("sharded_knn")
    def sharded(s, d):
        rows = corpus(s, d).select("id", "vector")
        return ivf.Sharded.build(rows, "l2", ShardConfig(8, 4), tune=(10, RECALL)).batch_search(rows.where(EVERY), 10)

    @register("ivfpq_knn")
    def ivfpq(s, d):
        rows = corpus(s, d).select("id", "vector")
        index = pq.IVFPQ.train(rows, IVFPQConfig(lists=16, nprobe=8, iterations=8)).add(rows).tuned(rows, 10, RECALL)
        return index.search_rescored(rows.where(EVERY), rows, 10)

    @register("pq_codes")
    def codes(s, d):
        rows = corpus(s, d).select("id", "vector")
        quantizer = pq.ProductQuantizer.train(kmeans.sample(rows, 4096), 8, 5)
        return pq.encode(rows, quantizer).select("id", "codes")

    @register("kmeans_assign")
    def clustered(s, d):
        rows = corpus(s, d).select("id", "vector")
        return kmeans.assign(rows, kmeans.refine(rows, kmeans.fit_on(rows, 10))).select("id", "list_id")

    # Lloyd rounds from the labels' means: assign, take means, assign again.
    again = "c2 AS (SELECT list_id, list(x ORDER BY place) AS center FROM (SELECT list_id, place, avg(x) AS x FROM (SELECT n.list_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS place FROM v JOIN n USING (id)) GROUP BY list_id, place) GROUP BY list_id)"
    last = f"SELECT v.id, arg_min(list_id, (round({_sql_distance('vector', 'center', 'l2')}, 9), list_id)) AS list_id FROM v, c2 GROUP BY v.id"

    @register("lloyd_round", f"WITH {V}, {mean}, {near}, {again} {last}")
    def lloyd(s, d):
        rows = corpus(s, d).select("id", "vector")
        return kmeans.assign(rows, kmeans.refine(rows, centers(s, d))).select("id", "list_id")

    # Codebooks by a formula, 8 subspaces of 16 codes used, so that SQL knows them too.
    book = np.array([[[((m * 17 + c * 31 + p * 7) % 23 - 11) / 4.0 for p in range(8)] for c in range(16)] for m in range(8)])
    code_rows = "b AS (SELECT m, c, list_transform(range(0, 8), lambda p: ((m * 17 + c * 31 + p * 7) % 23 - 11) / 4.0::DOUBLE) AS part FROM range(0, 8) t(m), range(0, 16) u(c))"
    coded = f"k AS (SELECT id, m, arg_min(c, (round({_sql_distance('vector[8 * m + 1 : 8 * m + 8]', 'part', 'l2')}, 9), c)) AS c, min({_sql_distance('vector[8 * m + 1 : 8 * m + 8]', 'part', 'l2')}) AS d FROM v, b GROUP BY id, m)"

    @register("pq_fixed_codes", f"WITH {V}, {code_rows}, {coded} SELECT id, string_agg(c::VARCHAR, ',' ORDER BY m) AS codes, round(sum(d), 6) AS error FROM k GROUP BY id")
    def fixed(s, d):
        rows = pq.encode(corpus(s, d).select("id", "vector"), pq.ProductQuantizer(book))
        error = D.l2("vector", D.pq_reconstruct("codes", F.array(*[F.array(*[knn.literal(part) for part in codes]) for codes in book])))
        return rows.select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), F.round(error, 6).alias("error"))

    tables = f"q AS (SELECT v.id AS query_id, m, c, {_sql_distance('vector[8 * m + 1 : 8 * m + 8]', 'part', 'l2')} AS t FROM v, b WHERE {EVERY})"
    sums = "SELECT query_id, id, sum(t) AS d FROM k JOIN q USING (m, c) GROUP BY query_id, id"

    @register("adc_knn", f"WITH {V}, {code_rows}, {coded}, {tables}, r AS (SELECT query_id, id, round(d, 6) AS d FROM ({sums})) SELECT query_id, rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM r) WHERE rank <= 10")
    def adc_knn(s, d):
        rows = corpus(s, d).select("id", "vector")
        quantizer = pq.ProductQuantizer(book)
        found = pq.adc_search(pq.encode(rows, quantizer).select("id", "codes"), quantizer, rows.where(EVERY), 10)
        return _rounded(found).select("query_id", "rank", "distance")


def _enough(found: DataFrame, truth: DataFrame, k: int, least: float = RECALL) -> DataFrame:
    """One row (queries, enough): how many queries there are, and whether the mean share of true neighbours found is enough."""
    share = evaluate.recall(found, truth, k).first()["recall"] or 0.0
    return truth.agg(F.countDistinct("query_id").alias("queries")).withColumn("enough", F.lit(bool(share >= least)))


ASKED = f"WITH {V} SELECT count(*) AS queries, true AS enough FROM v WHERE {EVERY}"


def _register_recalls() -> None:
    """Approximate searches against an exact one over the same rows."""
    cases = {"ivf_flat": ("cosine", 10), "sharded_knn": ("l2", 10), "ivfpq_knn": ("l2", 10), "beam_search": ("l2", 5), "layered_search": ("l2", 5)}
    for name, (metric, k) in cases.items():

        @register(f"{name}_recall", ASKED)
        def recall(s, d, name=name, metric=metric, k=k):
            rows = corpus(s, d).select("id", "vector")
            return _enough(QUERIES[name](s, d), knn.knn_join(rows.where(EVERY), rows, k, metric, "kernel"), k)

    @register("nn_descent_recall", f"WITH {V} SELECT count(*) AS queries, true AS enough FROM v")
    def descent(s, d):
        as_found = lambda e: e.select(F.col("src").alias("query_id"), (F.col("slot") + 1).alias("rank"), F.col("dst").alias("id"), "distance")
        return _enough(as_found(QUERIES["nn_descent"](s, d)), as_found(_graph(s, d)), 8)


def _graph(s: SparkSession, d: str) -> DataFrame:
    return graph.exact_graph(corpus(s, d).select("id", "vector"), 8, "l2", "blocks")


def _register_graphs() -> None:
    edges = f"e AS (SELECT query_id AS src, rank - 1 AS slot, id AS dst, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM ({_pairs('l2', 'true')}) WHERE query_id <> id) WHERE rank <= 8)"
    as_edges = f"WITH {V}, {edges} SELECT src, slot, dst, round(distance, 6) AS distance FROM e"

    register("knn_graph_edges", as_edges)(lambda s, d: _rounded(_graph(s, d)))
    register("reverse_edges", f"WITH {V}, {edges} SELECT dst, count(*) AS n, min(src) AS first FROM e GROUP BY dst")(lambda s, d: graph.reverse_edges(_graph(s, d)).groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("first")))
    register("entry_point", f"WITH {V}, {edges} SELECT src, round(sum(distance) / 8, 6) AS mean FROM e GROUP BY src ORDER BY sum(distance) / 8, src LIMIT 1")(lambda s, d: graph.entry_point(_graph(s, d), 8).withColumn("mean", F.round("mean", 6)))
    register("mean_farthest", f"WITH {V}, {edges} SELECT round(avg(far), 6) AS mean FROM (SELECT src, max(distance) AS far FROM e GROUP BY src)")(lambda s, d: graph.mean_farthest(_graph(s, d)).withColumn("mean", F.round("mean", 6)))

    @register("nn_descent")
    def descent(s, d):
        # Lists of 16 or more while it descends: with 8, vectors that do not cluster lose more than a tenth of their neighbours.
        return graph.nn_descent(corpus(s, d).select("id", "vector"), 16, "l2", 8, tune=(8, RECALL)).where("slot < 8")

    # Slot by slot: an edge joins the kept ones unless one of these is nearer to its end than its start is.
    nearer = _sql_distance("k", "t.vector", "l2")
    pruned_sql = f"""WITH RECURSIVE {V}, {edges}, t AS (SELECT e.*, v.vector FROM e JOIN v ON v.id = e.dst),
    p AS (SELECT src, -1::BIGINT AS slot, []::DOUBLE[][] AS kept, NULL::BIGINT AS dst, NULL::DOUBLE AS distance FROM (SELECT DISTINCT src FROM t)
    UNION ALL SELECT p.src, t.slot, CASE WHEN len(list_filter(p.kept, lambda k: {nearer} < t.distance)) = 0 THEN list_append(p.kept, t.vector) ELSE p.kept END, CASE WHEN len(list_filter(p.kept, lambda k: {nearer} < t.distance)) = 0 THEN t.dst END, t.distance FROM p JOIN t ON t.src = p.src AND t.slot = p.slot + 1)
    SELECT src, (row_number() OVER (PARTITION BY src ORDER BY slot) - 1)::INT AS slot, dst, round(distance, 6) AS distance FROM p WHERE dst IS NOT NULL"""

    @register("pruned_graph", pruned_sql)
    def pruned(s, d):
        return _rounded(graph.prune(_graph(s, d), corpus(s, d).select("id", "vector"), 8, "l2"))

    u = "('0x' || substr(md5(id::VARCHAR), 1, 13))::BIGINT + 1"
    @register("hnsw_levels", f"WITH {V} SELECT id, list_sum(list_transform(range(1, 7), lambda l: CASE WHEN {u} <= 1::BIGINT << (52 - l) THEN 1 ELSE 0 END))::INT AS level FROM v")
    def levels(s, d):
        return corpus(s, d).select("id", graph.hnsw_level("id").alias("level"))

    @register("beam_search")
    def beam(s, d):
        rows = corpus(s, d).select("id", "vector")
        return graph.beam_search(rows.where(EVERY), rows, materialize(_graph(s, d), "graph"), 5, 32, "l2", recall=RECALL)

    @register("layered_search")
    def layered(s, d):
        rows = corpus(s, d).select("id", "vector")
        edges = materialize(_graph(s, d), "graph")
        return graph.beam_search(rows.where(EVERY), rows, edges, 5, 32, "l2", graph.layers_of(edges, rows, 8, 6, "l2"), recall=RECALL)

    # A third of the rows comes later: each new node has its nearest, and is in the list of those whose worst neighbour is farther.
    first, later = "id % 3 < 2", "id % 3 = 2"

    def part(queries: str, rows: str) -> str:
        return f"SELECT query_id AS src, id AS dst, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM ({_pairs('l2', queries, rows)}) WHERE query_id <> id) WHERE r <= 8"

    inserted = f"WITH {V}, b AS ({part(first, first)}), n AS ({part(later, 'true')}), u AS (SELECT * FROM b UNION SELECT * FROM n UNION SELECT dst, src, d FROM n) SELECT src, (slot - 1)::INT AS slot, dst, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS slot FROM u) WHERE slot <= 8"

    @register("graph_insert", inserted)
    def insertion(s, d):
        rows = corpus(s, d).select("id", "vector")
        index = GraphIndex.build(rows.where(first), 8, "l2", 0)
        index.insert(rows.where(later))
        return _rounded(index.edges())

    @register("skip_layers_recall", f"WITH {V} SELECT count(*) FILTER (WHERE list_sum(list_transform(range(1, 3), lambda l: CASE WHEN {u} <= 1::BIGINT << (52 - l) THEN 1 ELSE 0 END)) >= 1) AS queries, true AS enough FROM v")
    def skip_layers(s, d):
        rows = corpus(s, d).select("id", "vector")
        first_layer = lambda e: e.where("layer = 1").select(F.col("src").alias("query_id"), F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst")).alias("rank"), F.col("dst").alias("id"), "distance")
        edges = materialize(_graph(s, d), "graph")
        return _enough(first_layer(graph.layers_of(edges, rows, 4, 2, "l2")), first_layer(graph.hnsw_layers(rows, 4, 2, "l2")), 4, 0.85)

    # Repair looks anew at some nodes of an exact graph, and so must give that graph.
    @register("graph_repair", as_edges)
    def repaired(s, d):
        rows = corpus(s, d).select("id", "vector")
        return _rounded(graph.repair(materialize(_graph(s, d), "graph"), rows, rows.where(EVERY).select("id"), 8, "l2"))


def _register_sets() -> None:
    def ranked_part(name: str, where: str, asked: str) -> str:
        return f"{name} AS (SELECT query_id, id, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM ({_pairs('cosine', asked, where)}) QUALIFY r <= 10))"

    @register(f"base_delta_search", f"WITH {V}, {ranked_part('b', 'id % 3 < 2 AND NOT dead', EVERY)}, {ranked_part('x', 'id % 3 > 0 AND NOT dead', EVERY)} {_ranked('SELECT query_id, id, min(d) AS d FROM (SELECT * FROM b UNION ALL SELECT * FROM x) GROUP BY query_id, id', 10)}")
    def base_delta(s, d):
        rows = corpus(s, d).select("id", "vector")
        live, q = knn.live(rows, rows.where("id % 10 = 3")), rows.where(EVERY)
        found = [knn.knn_join(q, live.where(w), 10, "cosine").select("query_id", "id", "distance") for w in ("id % 3 < 2", "id % 3 > 0")]
        return _rounded(knn.merge_results(*found, k=10))

    # Ids arrive in seven batches, again and again; the first row of an id stays, and one in ten is deleted at the end.
    @register("streaming_merge_dedupe", "WITH n AS (SELECT count(*) AS n FROM embeddings), a AS (SELECT event_id % n AS id, min(event_id % 7) AS batch FROM events, n GROUP BY 1) SELECT id, batch, batch * 10 + id % 10 AS value FROM a WHERE id % 10 <> 3")
    def merge_dedupe(s, d):
        n = table(s, d, "embeddings").count()
        e = F.col("event_id")
        rows = table(s, d, "events").select((e % n).alias("id"), (e % 7).alias("batch"))
        arrivals = materialize(rows.groupBy("id", "batch").agg(F.array((F.col("batch") * 10 + F.col("id") % 10).cast("float")).alias("vector")), "arrivals")
        path = work_path(s, "stream")
        arrivals.select(F.col("id"), "vector", "batch").repartition(7, "batch").write.partitionBy("batch").parquet(f"{path}/in")
        index = None
        for batch in range(7):  # each batch by a new object on the folder, as after a restart
            index = StreamIndex(s, "bigint", IndexConfig(metric="l2"), StreamConfig(delta_capacity=max(1, n // 3), strict=False), f"{path}/state")
            index.insert(s.read.schema("id bigint, vector array<float>").parquet(f"{path}/in/batch={batch}"), batch)
            index.insert(arrivals.limit(1), batch)  # a replay
        rows = knn.live(index.rows(), arrivals.where("id % 10 = 3"))
        return rows.select("id", "batch", F.col("vector")[0].cast("long").alias("value"))

    # Deletions of many ids between merges, by two writers on one folder, each from what the other has committed.
    @register("stream_delete_many", f"WITH {V} SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS batch FROM v WHERE id % 7 <> 1 AND id % 5 <> 2")
    def delete_many(s, d):
        rows = corpus(s, d).select("id", F.col("vector").cast("array<float>").alias("vector"))
        path = work_path(s, "stream")
        one, two = (StreamIndex(s, "bigint", IndexConfig(metric="l2"), StreamConfig(delta_capacity=1 << 30), path) for _ in range(2))
        one.insert(rows.where("id % 2 = 0"), 0)
        two.delete_all(rows.where("id % 2 = 0 AND id % 7 = 1").select("id"))
        two.insert(rows.where("id % 2 = 1"), 1)
        one.merge()
        one.delete_all(rows.where("id % 2 = 1 AND id % 7 = 1 OR id % 5 = 2 AND id % 7 <> 1").select("id"))
        two.flush()
        return two.rows().select("id", "batch")

    @register("snapshot_unmatched", f"WITH {V}, m AS (SELECT id + 3 AS id FROM v WHERE id % 2 = 0), t AS (SELECT -id - 1 AS id FROM v WHERE id % 4 = 0) SELECT 'metadata' AS \"table\", id, 'unknown' AS problem FROM m WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT 'tombstones', id, 'unknown' FROM t UNION ALL SELECT 'vectors', id, 'twice' FROM v WHERE id % 9 = 0")
    def unmatched(s, d):
        rows = corpus(s, d).select("id")
        tables = {"vectors": rows.unionByName(rows.where("id % 9 = 0")), "metadata": rows.where("id % 2 = 0").select((F.col("id") + 3).alias("id")), "tombstones": rows.where("id % 4 = 0").select((-F.col("id") - 1).alias("id"))}
        return store.unmatched(tables)

    @register("live_counts", f"WITH {V} SELECT label, count(*) AS n, count(*) FILTER (WHERE NOT dead) AS live FROM v GROUP BY label")
    def counts(s, d):
        rows = corpus(s, d)
        live = knn.live(rows, rows.where("id % 10 = 3")).groupBy("label").agg(F.count("*").alias("live"))
        return rows.groupBy("label").agg(F.count("*").alias("n")).join(live.withColumnRenamed("label", "l"), F.expr("label <=> l"), "left").select("label", "n", F.coalesce("live", F.lit(0)).alias("live"))

    @register(f"index_lifecycle", f"WITH {V}, w AS (SELECT id, vector FROM v WHERE id % 10 <> 3) SELECT query_id, rank, id, round(d, 3) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (SELECT q.id AS query_id, w.id, {_sql_distance('w.vector', 'q.vector', 'l2')} AS d FROM (SELECT * FROM v WHERE {EVERY}) q, w)) WHERE rank <= 5")
    def lifecycle(s, d):
        rows = corpus(s, d).select("id", F.col("vector").cast("array<float>").alias("vector"))
        index = UnbuiltIndex(IndexConfig(metric="l2")).build(rows.where("id % 4 <> 0")).batch_insert(rows.where("id % 4 = 0"))
        index = index.delete(rows.where("id % 10 = 3").select("id")).compact()
        return _rounded(index.batch_search(rows.where(EVERY), 5)).withColumn("distance", F.round("distance", 3))


def _register_evaluation() -> None:
    @register("recall_at_10", f"WITH {V}, t AS ({_ranked(_pairs('l2', EVERY), 10)}), f AS ({_ranked(_pairs('cosine', EVERY), 10)}) SELECT round(avg(r), 6) AS recall FROM (SELECT t.query_id, count(f.id) / count(*) AS r FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.id = t.id GROUP BY t.query_id)")
    def recall(s, d):
        rows = corpus(s, d).select("id", "vector")
        q = rows.where(EVERY)
        return evaluate.recall(knn.knn_join(q, rows, 10, "cosine"), knn.knn_join(q, rows, 10, "l2"), 10).withColumn("recall", F.round("recall", 6))

    @register("latency_percentiles", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999 FROM events")
    def latency(s, d):
        return evaluate.latency_stats(table(s, d, "events")).withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})

    @register("latency_histogram", "WITH b AS (SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10.0)::INT + 1 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT bucket, n, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 9) AS cdf FROM b")
    def histogram(s, d):
        return evaluate.histogram(table(s, d, "events"), 0.0, 100.0, 10).withColumn("cdf", F.round("cdf", 9))

    points = "SELECT p_partkey AS k, (p_partkey * 7919 % 1000) / 1000.0 AS recall, (p_partkey * 104729 % 977)::DOUBLE AS qps FROM part"

    @register("pareto_frontier", f"WITH p AS ({points}) SELECT k, recall::DOUBLE AS recall, qps FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.recall >= p.recall AND o.qps >= p.qps AND (o.recall > p.recall OR o.qps > p.qps))")
    def pareto(s, d):
        k = F.col("p_partkey")
        p = table(s, d, "part").select(k.alias("k"), (k * 7919 % 1000 / 1000.0).alias("recall"), (k * 104729 % 977).cast("double").alias("qps"))
        return evaluate.pareto(p)


for _f in (_register_searches, _register_filters, _register_expressions, _register_lists, _register_graphs, _register_recalls, _register_sets, _register_evaluation):
    _f()
