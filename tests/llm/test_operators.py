"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing extra columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield import runtime
from nearfield.llm import bpe, components, dealt, embedding_dedup, grouping, html_text, langid, licenses, minhash, mixing, ordered, queries, suffix_dedup, topk, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n long, id string, rank int"
P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, first=0):
    """Documents with extra columns whose names operators use inside."""
    rows = [(i + first, t, f"s{i % 3}" if i % 4 else None, 7, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng, words, vocabulary=40):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(1 + rng.randrange(vocabulary) % 7)) for _ in range(words))


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text, width):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_texts():
    rng = random.Random(3)
    base = prose(rng, 120, 300).split()
    texts = [" ".join(base), None, "", "   \n", "one", "One", "one two", prose(rng, 3000, 300)]
    for k in range(40):  # a chain of near copies, many at the edge of the threshold
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 5 + [prose(rng, 60, 300) for _ in range(10)]
    return texts


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block,large", [(300, 4096), (9, 4096), (3, 10)])
def test_minhash(spark, monkeypatch, width, percent, block, large):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", large)
    texts = near_texts()
    sets = [shingle_set(t, width) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = union_find(len(texts), links)
    found = minhash.near_duplicates(docs(spark, texts), width, percent).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, root))]


def test_minhash_of_a_hot_bucket(spark):
    """20,000 distinct near copies in one bucket: work in proportion to them, and one group."""
    rng = random.Random(17)
    base = prose(rng, 110, 3000).split()
    one = lambda k: " ".join([*base[:k % 80], f"x{k}", *base[k % 80 + 1 :]])
    df = spark.createDataFrame([(k, one(k)) for k in range(20_000)] + [(50_000 + k, prose(rng, 100, 3000)) for k in range(50)], "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    found = minhash.near_duplicates(df, 3, 85).groupBy("component_id").count().orderBy(F.desc("count")).collect()
    assert [r["count"] for r in found] == [20_000] + [1] * 50 and time.perf_counter() - began < 240


def test_minhash_edges(spark):
    more = docs(spark, ["a b c d", "a b c d"]).withColumns({c: F.lit(9) for c in ("kept", "component_id", "n_shingles", "band", "key", "component")})
    assert sorted(tuple(r) for r in minhash.near_duplicates(more, 3, 85).collect()) == [(0, 2, 0, True), (1, 2, 0, False)]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(rows).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    bands, rows_ = minhash.layout(85)
    assert (1 - 0.85**rows_) ** bands <= 1e-6 and bands * rows_ <= minhash.HASHES


@pytest.mark.parametrize("most", [2 << 20, 0])
def test_rows_by_ids(spark, monkeypatch, most):
    monkeypatch.setattr(grouping, "BROADCAST_IDS", most)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "doc_id int, text string")
    ids = spark.createDataFrame([(1,), (3,), (9,)], "doc_id long")
    found = {how: sorted(r["text"] for r in grouping.matching(rows, ids, "doc_id", how).collect()) for how in ("left_semi", "left_anti")}
    assert found == {"left_semi": ["a", "b", "e"], "left_anti": ["c", "d"]}
    assert sorted(r["text"] for r in grouping.matching(rows, ids.limit(0), "doc_id", "left_anti").collect()) == list("abcde")
    plan = grouping.matching(rows, ids, "doc_id")._jdf.queryExecution().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 0)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(30)] + [(50, rng.randrange(51, 90)) for _ in range(60)] + [(100, 100)]
    root = union_find(101, links)
    edges = spark.createDataFrame([*links, (None, 3)], "src long, dst long")
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert found == {x: root[x] for a, b in links if a != b for x in (a, b)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_few_edges_take_few_files(spark, monkeypatch):
    """Each file costs processes that count as copies of the executor while they start."""
    monkeypatch.setattr(components, "materialize", lambda df, name, made=components.materialize: written.append(made(df, name)) or written[-1])
    monkeypatch.setattr(components, "discard", lambda df: None)
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, written = {k: spark.conf.get(k) for k in changed}, []
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") - F.col("id") % 7).alias("dst"))
        found = {r["node"]: r["component"] for r in components.connected_components(edges, rows=300).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i - i % 7 for i in range(300)}
    assert len(written) == 2 and all(len(w.inputFiles()) == 1 for w in written)  # stars are seen to be stars in one round


def test_many_candidates_need_little_memory():
    """1,500 rows that are alike, none linked yet: 1.1 million pairs are left of them, of which only the rows are asked for."""
    n = 1500
    least = minhash.minima(np.arange(1, 200, dtype=np.uint64))
    group = pa.table({
        **{k: pa.array([v] * n, t) for k, v, t in (("band", 0, pa.int32()), ("key", 1, pa.int64()), ("kind", 2, pa.int32()), ("i", 0, pa.int32()), ("j", 0, pa.int32()))},
        "doc_id": pa.array(range(n), pa.int64()), "component": pa.array(range(n), pa.int64()), "is_left": pa.array([True] * n), "is_right": pa.array([True] * n), "n_shingles": pa.array([199] * n, pa.int64()),
        "bands": pa.array([minhash.band_keys(least, *minhash.layout(85))] * n, pa.list_(pa.int64())), "signature": pa.array([least.astype("<u2").tobytes()] * n, pa.binary()),
    })
    tracemalloc.start()
    try:
        paired = {int(x) for a, *others in minhash.candidates(group, 85) for x in (a, *np.ravel(others[0]))}
        assert paired == set(range(n)) and tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_running_sums(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    found = ordered.running_sums(rows, [F.desc("id")], {"total": "v"}, "t").orderBy(F.desc("id")).collect()
    assert [r["total"] for r in found] == list(itertools.accumulate(i % 7 for i in range(999, -1, -1)))


def plain_mix(rows, weights, percent):
    """rows: (doc_id, source, size), in the order of their hashes within a source."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    budget, left, target = sum(size.values()) * percent / 100, set(sources), {}
    while True:
        share = (budget - sum(target.values())) / sum(weight[s] for s in left) if left else 0
        full = {s for s in left if share * weight[s] > 2 * size[s]}
        if not full:
            return target | {s: share * weight[s] for s in left}, size
        target |= {s: 2.0 * size[s] for s in full}
        left -= full


def test_mixing(spark):
    rng = random.Random(1)
    texts = [None, "", *(prose(rng, rng.randrange(1, 60)) for _ in range(150))]
    df = docs(spark, texts)
    found = mixing.mix(df, [5, 2, 1], 150, carry=["id"]).collect()
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    target, total = plain_mix([(i, source[i], sizes[i]) for i in sizes], [5, 2, 1], 150)
    taken = collections.Counter()
    for r in found:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]] and r["carried"]["id"] == "x"
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(found) == len(texts) and all(abs(taken[s] - target[s]) <= 60 for s in target)
    again = mixing.mix(df.repartition(5), [5, 2, 1], 150).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in found}
    assert mixing.mix(df.limit(0), [5, 2, 1], 150).count() == 0
    assert mixing.mix(df.where("doc_id < 2"), [1], 100).count() == 2
    clashing = df.withColumns({c: F.lit(9) for c in ("size", "taken", "target", "row", "hash", "end", "kept", "carried")})
    same = mixing.mix(clashing, [5, 2, 1], 150, carry=["size", "taken", "target", "row", "carried"])
    assert {r["doc_id"]: (r["taken"], r["carried"]["taken"]) for r in same.collect()} == {r["doc_id"]: (r["taken"], 9) for r in found}
    twice = mixing.mix(df.where("doc_id = 5").unionAll(df.where("doc_id = 5")), [1], 100)
    assert twice.count() == 2


def vectors(rng):
    x = rng.normal(size=(60, 8))
    x[20:35] = x[20] + rng.normal(size=(15, 8)) * 0.12
    x[35:40] = x[36]
    rows = [(i, [float(v) for v in r], int(i // 30)) for i, r in enumerate(x)]
    odd = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 4, [2.0] * 4]
    return rows + [(60 + i, v, 1) for i, v in enumerate(odd)] + [(80, rows[36][1], None), (81, rows[36][1], 1)]


@pytest.mark.parametrize("cell,block", [(1024, 1024), (5, 4)])
def test_embedding_dedup(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(np.random.default_rng(8))

    def linked(a, b):
        (_, x, l), (_, y, m) = a, b
        if l is None or l != m or x is None or y is None or None in x or None in y or len(x) != len(y):
            return False
        x, y = np.array(np.float32(x), float), np.array(np.float32(y), float)
        size = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
        return bool(np.isfinite(size) and size > 0 and (x * y).sum() / size >= 0.98)

    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if linked(rows[i], rows[j])]
    assert len(pairs) > 30
    root = union_find(len(rows), pairs)
    n = collections.Counter(x for p in pairs for x in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = embedding_dedup.near_duplicates(df, replicas=None).orderBy("vec_id").collect()
    assert [tuple(r) for r in found] == [(rows[i][0], n[i], rows[root[i]][0], root[i] == i) for i in range(len(rows))]
    clashing = df.withColumns({c: F.lit(9) for c in ("id", "vector", "copies", "dims", "cell", "home", "kept", "n_links")})
    near = embedding_dedup.near_duplicates(clashing).orderBy("vec_id").collect()
    assert all(a["n_links"] <= b["n_links"] for a, b in zip(near, found)) and sum(r["n_links"] for r in near) >= 0.9 * sum(n.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("replicas", [None, 4])
def test_embedding_recall(spark, monkeypatch, replicas):
    """Many cells, links within and across them: counts from brute force; the bounded form finds 0.9 of them at least."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[300:] = x[rng.integers(0, 300, 300)] + rng.normal(size=(300, 16)) * 0.1
    x = np.float32(x).astype(float)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (y @ y.T >= 0.98) & ~np.eye(600, dtype=bool)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    found = np.array([r["n_links"] for r in embedding_dedup.near_duplicates(df, replicas=replicas).orderBy("vec_id").collect()])
    assert (found <= links.sum(1)).all() and found.sum() >= (1 if replicas is None else 0.9) * links.sum() and links.sum() > 300


def test_many_centroids_need_little_memory():
    """At 10,000 centroids neither fitting nor assigning makes a matrix of all of them."""
    import tracemalloc

    rng = np.random.default_rng(6)
    points = embedding_dedup.unit(rng.normal(size=(12_000, 16)))
    tracemalloc.start()
    centers = embedding_dedup.spherical_kmeans(points, 10_000, 1)
    home, row, goes = embedding_dedup.cells_of(points[:1000], centers, 0.2, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(centers) == 10_000 and most < 250 << 20
    near = points[:1000] @ centers.T
    assert (home == near.argmax(1)).all() and {(i, h) for i, h in enumerate(home.tolist())} <= set(zip(row.tolist(), goes.tolist()))
    assert len(row) <= 5 * 1000 + 1000


def test_embedding_sizes(spark):
    """Components whose squares no double holds."""
    rows = [(1, [1e-300, 2e-300]), (2, [2e300, 4e300]), (3, [1e-200, -1e-200])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert [embedding_dedup.cell_count(n) for n in (0, 1, 1024, 1025, 10**6, 10**10)] == [1, 1, 1, 2, 977, 100_000]


@pytest.mark.parametrize("block,step", [(4096, 64), (16, 2)])
def test_top_k(spark, monkeypatch, block, step):
    monkeypatch.setattr(dealt, "BLOCK", block)
    monkeypatch.setattr(dealt, "LEAST", block)
    monkeypatch.setattr(dealt, "QUERIES", 7)
    monkeypatch.setattr(dealt, "PART_BYTES", 40 * block)
    monkeypatch.setattr(topk, "STEP", step)
    rows = [r for r in vectors(np.random.default_rng(9))] + [(100, [0.5] * 8, 0), (200, [-0.5] * 8, 0), (201, [-0.5] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    good = {i: np.floor(1024 * np.array(np.float32(v), float)).astype(int) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()}
    expected = []
    for q in (i for i in good if i % 10 == 0):
        scores = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    found = topk.top_k(df, df.where("vec_id % 10 = 0"), 5).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0
    more = df.withColumns({c: F.lit(9) for c in ("id", "values", "block", "score", "rank", "query_id")})
    assert sorted(tuple(r) for r in topk.top_k(more, more.where("vec_id % 10 = 0"), 5).collect()) == sorted(expected)


def test_top_k_of_repeated_rows_and_large_values(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, schema)
    found = topk.top_k(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 1024 * 512), (0, 2, 1, 1024 * 512), (0, 3, 2, 1024 * 256)]
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (4, [0.0, 2.0]), (5, [2.0, 0.0])], schema)
    found = topk.top_k(two, two.where("vec_id = 0"), 1).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 4, 1024 * 2048), (0, 1, 5, 1024 * 2048)]
    # Below 2**63 scores are exact whatever the components are; beyond it there is no wrong number.
    large = spark.createDataFrame([(0, [2.0**-10, 0.0]), (1, [2.0**52, 1.0]), (2, [2.0**50, -1.0]), (3, [-(2.0**90), 0.0])], schema)
    assert [tuple(r) for r in topk.top_k(large, large.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(0, 1, 1, 2**62), (0, 2, 2, 2**60)]
    with pytest.raises(Exception, match="does not fit into a long"):
        topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [1e30])], schema), large.limit(0).unionByName(spark.createDataFrame([(0, [1.0])], schema)), 1).collect()


def test_top_k_scans_stop_on_proof():
    rng = np.random.default_rng(2)
    values = rng.integers(-400, 400, size=(4000, 16))
    index = topk.ImpactIndex(np.arange(4000), values)
    for q in (*values[:5], np.zeros(16, int), rng.integers(-5, 5, 16)):
        place, score = index.search(q, 10, None)
        best = np.lexsort((np.arange(4000), -(values @ q)))[:10]
        assert place.tolist() == best.tolist() and score.tolist() == (values @ q)[best].tolist()
    assert len(index._possible(values[0], 10, np.zeros(4000, bool))) < 4000


def test_language(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["éu", "re", "qua"], "cc": ["ßt", "ung", "ich"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(3))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(5, 60))), lang) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(200))]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 !?", "bb"), (903, "kalomi " * 200_000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).repartition(3)
    model = langid.train(df.where("doc_id % 4 <> 2"))
    assert model.names == sorted(syllables) and model.matrix.shape == (langid.BUCKETS, 3)
    found = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in held]) >= 0.98
    assert [found[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    empty = langid.train(df.limit(0))
    assert empty.names == [] and {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    kept = langid.predict(df, model, names=("a", "b")).collect()
    assert {r["doc_id"]: (r["a"], r["b"], r["score"]) for r in kept} == {i: (r["lang_pred"], r["score"], "clash") for i, r in found.items()}


def plain_grams(text):
    """The buckets of a text's n-grams, one by one in whole numbers."""
    if not text:
        return
    letters = re.sub(r" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " ")
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            h = 0
            for m in range(n):
                h = (h * 0x100000001B3 + ord(letters[i + m]) + m + 1) % 2**64
            yield ((h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64) >> 48


def plain_bayes(rows):
    """(language, posterior) of each text by a naive Bayes of dictionaries, learned from all rows (text, lang)."""
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(plain_grams(text))
            texts[lang] += 1
    total = {lang: sum(c.values()) + 0.5 * 2**16 for lang, c in counts.items()}

    def judge(text):
        if not counts or not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        grams = collections.Counter(plain_grams(text))
        logs = {lang: np.log(texts[lang] / sum(texts.values())) + sum(n * np.log((c[g] + 0.5) / total[lang]) for g, n in grams.items()) for lang, c in counts.items()}
        best = min(logs, key=lambda lang: (-logs[lang], lang))
        return best, 1 / sum(np.exp(x - logs[best]) for x in logs.values())

    return judge


@pytest.mark.parametrize("block,languages", [(1 << 19, 32), (10_000, 2)])
def test_language_is_naive_bayes(spark, monkeypatch, block, languages):
    monkeypatch.setattr(langid, "LANGUAGES", languages)
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(0, 30)) if i % 11 else None, rng.choice(["aa", "bb", "cc", None])) for i in range(80)]
    rows += [(100 + i, t, "dd") for i, t in enumerate(["ÀÉ ßΣ", "x", "日本 語", "12", "a" * 5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    judge = plain_bayes([(t, lang) for _, t, lang in rows])
    model = langid.train(df)
    monkeypatch.setattr(langid, "BLOCK", block)
    sums, known = langid.scores([t for _, t, _ in rows], model)
    found = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    for at, (i, text, _) in enumerate(rows):
        lang, score = judge(text)
        assert found[i]["score"] == pytest.approx(score, abs=1e-3) and (found[i]["lang_pred"] == lang or score < 0.51), (i, text)
        assert known[at] == (lang != "und") and (lang == "und" or model.names[sums[at].argmax()] == found[i]["lang_pred"])


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    return path, ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, tokenizer):
    path, ranks, reference = tokenizer
    rng = random.Random(4)
    alphabet = "aàbcd ñ  тест漢 字😀\n\t12 th in\r er !?-ßü é'srdl\x1c"
    texts = [None, "", " ", "  \n ", "it's we're'll 'tis ''s I'd'x  's don't'", "a" * 3000, " " * 500, "é" * 100, "x" * 41 + "'ll", prose(rng, 20_000)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    found = bpe.decode(bpe.encode(docs(spark, texts), path, P.PATTERN), path).orderBy("doc_id").collect()
    for r, t in zip(found, texts):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == reference.encode_ordinary(t or "") and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (t or "").encode() and r["source"] != ""
    both = bpe.encode(docs(spark, texts), path, P.PATTERN, decoded="decoded").orderBy("doc_id").collect()
    assert [(r["ids"], r["decoded"], r["n_tokens"]) for r in both] == [(r["ids"], r["decoded"], r["n_tokens"]) for r in found]
    assert bpe.encode(docs(spark, []), path, P.PATTERN).count() == 0
    other = bpe.Encoder(ranks, r"\w+|\W")
    assert np.frombuffer(other.encode("ab cd!"), "<u4").tolist() == [i for p in ("ab", " ", "cd", "!") for i in bpe.merge_encode(p.encode(), ranks)]


def test_bpe_prefix_tables(tokenizer):
    _, ranks, _ = tokenizer
    rng = random.Random(6)
    table = bpe.PrefixTable(bpe.Vocabulary(ranks))
    text = b""
    for _ in range(30):
        if text and rng.random() < 0.4:
            a = rng.randrange(len(text))
            b = rng.randrange(a, min(len(text), a + 4) + 1)
            new = prose(rng, 1).encode()
            table.edit(a, b, new)
            text = text[:a] + new + text[b:]
        else:
            more = prose(rng, 1).encode()
            table.append(more)
            text += more
        assert table.piece == text and table.tokens() == bpe.merge_encode(text, ranks)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, key int").repartition(3)


def test_warc(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", "", "same", "same", "same", prose(rng, 50_000)] + [f"<p>{prose(rng, 200)}</p>" for _ in range(60)]
    urls = [None, "http://a/b c\r\nX: y", "http://ü/%20"]
    rows = [(i, urls[i % 3], t) for i, t in enumerate(texts)]
    for least, name in ((0, "a"), (5, "b")):
        warc.write(pages(spark, rows), str(tmp_path / name), least=least)
        found = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / name)).collect()}
        last = {}
        for i, _, t in rows:
            if len((t or "").encode()) >= least:
                last[t or ""] = i
        assert sorted(found) == list(range(len(texts)))
        for i, url, t in rows:
            raw, r, answer = (t or "").encode(), found[i], last.get(t or "", i)
            assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if answer == i else ("revisit", answer))
            assert (bytes(r["payload"]) == raw) if answer == i else r["payload"] is None
    warc.write(pages(spark, []), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    twice = pages(spark, [(1, None, "x"), (1, None, "x"), (None, None, "x")])
    warc.write(twice, str(tmp_path / "twice"))
    assert [r["record_type"] for r in warc.read(spark, str(tmp_path / "twice")).collect()] == ["response", "response"]


def test_warc_files(tmp_path):
    import zstandard

    rng = random.Random(1)
    records = [warc.record(i, f"http://x/{i}", prose(rng, 300).encode(), None) for i in range(200)]
    parts = list(warc.frames(iter(records)))
    archive = warc.SEPARATOR.encode().join(parts) + warc.SEPARATOR.encode()
    assert archive[:4] == b"\x5d\x2a\x4d\x18" and list(warc.unframed(archive)) == records
    assert len(archive) < len(zstandard.compress(b"".join(zstandard.compress(r) for r in records)))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.unframed(archive[:-30]))
    assert list(warc.unframed(b"".join(warc.frames(iter(records[:1]))))) == records[:1]


def test_licenses(spark):
    assert licenses.gate_is_sound(licenses.THRESHOLD)
    named = [t for _, t in licenses.TEMPLATES]
    texts = [None, "", "license", "Nothing here.\nReleased under the MIT License.\nMore.", *named, "x " * 5000 + "\n\nLicensed under the\nMIT License.\n\nend", "this license is something else entirely", *named[:2]]
    found = licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()

    def best(text):
        units = {u for p in (licenses.SENTENCE, licenses.LINE, licenses.PARAGRAPH) for u in re.split(p, re.sub(licenses.COMMENT, r"\1", (text or "").lower()))}
        sets = {frozenset(licenses.bigrams_of(u)) for u in units} - {frozenset()}
        scores = {}
        for s in sets:
            each = [(2 * len(s & set(licenses.bigrams_of(t))) / (len(s) + len(licenses.bigrams_of(t))), n) for n, t in licenses.TEMPLATES]
            top = max(x for x, _ in each)
            if top >= licenses.THRESHOLD:
                scores[s] = (top, min(n for x, n in each if x == top))
        top = max((x for x, _ in scores.values()), default=0.0)
        return (min((n for x, n in scores.values() if x == top), default=None), top, len(scores))

    for r, t in zip(found, texts):
        name, score, n = best(t)
        assert r["score"] == pytest.approx(score) and r["n_units"] == n and (r["license"] is None) == (name is None), t
    assert [r["license"] for r in found[4 : 4 + len(named)]] == [n for n, _ in licenses.TEMPLATES]
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    wrapped = "\n * ".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    blocks = [
        ("This work is licensed under the GNU General Public License, version 1.", "GPL", None), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0", 1.0),
        ("Licensed under the Apache License, Version 1.1", None, 0.0), (f"/*\n * Copyright of somebody\n *\n * {wrapped}\n *\n * The end.\n */\nint main();", "MIT", 1.0),
        ("# Some words\n#\n# Released under\n# the MIT License.\n#\nx = 1", "MIT", 1.0),
    ]
    for r, (text, name, score) in zip(licenses.scan(docs(spark, [b[0] for b in blocks])).orderBy("doc_id").collect(), blocks):
        assert r["license"] == name and (score is None or r["score"] == pytest.approx(score)), text
    assert licenses.scan(docs(spark, [])).count() == 0
    plan = licenses.scan(docs(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_removal(rows, window):
    """rows: (doc_id, bytes)."""
    least = {}
    for i, b in rows:
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            least[s] = min(least.get(s, i), i)
    for i, b in rows:
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < i:
                cut[p : p + window] = True
        spans = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        yield i, len(b), int(cut.sum()), spans, bytes(x for x, c in zip(b, cut) if not c)


@pytest.mark.parametrize("batch,chunk,hot", [(3 << 20, 1 << 19, 8192), (700, 256, 8192), (700, 256, 3)])
def test_suffix_dedup(spark, monkeypatch, batch, chunk, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "_powers", None)
    rng = random.Random(11)
    passages = [prose(rng, 12) for _ in range(4)] + ["a" * 70, "ab" * 40, "é" * 30]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 400]
    for _ in range(60):
        parts = [prose(rng, rng.randrange(1, 25)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages)[rng.randrange(12) :])
        texts.append(rng.choice(["", " "]).join(parts))
    texts += texts[-5:]
    df = docs(spark, texts)
    found = suffix_dedup.remove_repeats(df, carry=["source", "n"]).orderBy("doc_id").collect()
    expected = list(plain_removal([(i, (t or "").encode()) for i, t in enumerate(texts)], suffix_dedup.WINDOW))
    assert [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found] == expected
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    assert all(r["carried"]["source"] == source[r["doc_id"]] and r["carried"]["n"] == 7 for r in found)
    assert sum(r["n_removed"] > 0 for r in found) > 30


def test_suffix_dedup_edges(spark):
    clashing = docs(spark, ["x" * 60, "x" * 60]).withColumns({c: F.lit(9) for c in ("kept", "n_removed", "n_bytes", "carried", "batch")})
    found = suffix_dedup.remove_repeats(clashing, carry=["kept", "n_removed", "carried"]).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["carried"]["kept"], r["carried"]["carried"]) for r in found] == [(0, 9, 9), (60, 9, 9)]
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    text = "abcdefghij" * 9
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(rows).collect()) == [(1, 0), (1, 0), (2, 90)]


def test_suffix_dedup_leaves_no_shuffle_files(spark):
    """Each step is written once, so what it shuffled is of no use afterwards; it took the disk until the driver collected garbage."""
    blocks = lambda: {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n") if b.startswith("shuffle_")}
    rng = random.Random(9)
    same = prose(rng, 60)
    there, setting = blocks(), spark.conf.get(runtime.SWEEP, "false")
    found = suffix_dedup.remove_repeats(docs(spark, [f"{prose(rng, 30)} {same} {prose(rng, 30)}" for _ in range(40)]))
    for _ in range(50):  # they are deleted by a message to the executors
        if not (left := blocks() - there):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(runtime.SWEEP) == setting
    assert found.where("n_removed > 0").count() == 39


@pytest.mark.parametrize("bits", [suffix_dedup.PLACE_BITS, 4])
def test_expansion_is_the_lcp_array(monkeypatch, bits):
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", bits)
    rng = random.Random(12)
    for alphabet in ("ab", "abcdefgh"):
        text = np.frombuffer(("".join(rng.choice(alphabet) for _ in range(500)) * 2).encode() + b"\0", np.uint8)
        raw = text.tobytes()
        order = suffix_dedup.suffix_order(text)
        assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(raw)))
        placed = suffix_dedup.expand(text[order - 1], 50)
        common = [0] + [next((k for k in range(50) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or a + k >= len(raw)), 50) for a, b in zip(order, order[1:])]
        assert placed.tolist() == [c < 50 for c in common]


PAGE = """<!DOCTYPE html><html class="home sidebar-left"><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<div id="cookie-notice"><p>We use cookies and you should accept all of them before you read anything at all on this site.</p></div>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a><li><a href='/b>c'>News</a></ul></nav><div class="ad">Buy now!</div>
<article><h1>Title &amp; more</h1><p>First paragraph with <a href="x">one link</a> and&nbsp;some   further words to read.<p>Second &#x41;&#66; one<br>goes on here<!-- <p>comment</p> --> to its end.</p>
<form><label>Mail</label><input><button>Send it</button></form><aside>Read also</aside><div class="comments"><p>A reader says a lot about this article here.</p></div></article>
<aside>Popular this week</aside><footer>&copy; nobody</footer></body></html>"""


def test_html(spark):
    expected = "Title & more First paragraph with one link and some further words to read. Second AB one goes on here to its end."
    body = "Words of a long enough paragraph that says something to its readers and does not stop soon."
    cases = [
        (PAGE, expected), (None, ""), ("", ""), ("<p", ""), ("plain words that stand in no element at all, as text files have them.", "plain words that stand in no element at all, as text files have them."), (PAGE.replace("</article>", ""), expected),
        (f"<div class=menu><a href=x>a</a></div><p>{body}</p>", body), (f"<article><p>{body}</p></article><script>unclosed", body),
        (f"<article><p>{body}</p>" * 3000, " ".join([body] * 3000)), (f'<article><p style="display:none">{body}</p><p>{body}</p><p a="b>{body}</p></article>', f"{body} {body}"),
    ]
    found = {r["page_id"]: r for r in html_text.extract(pages(spark, [(i, "u", c[0]) for i, c in enumerate(cases)])).collect()}
    for i, (page, text) in enumerate(cases):
        assert found[i]["n_chars"] == len(found[i]["text"]) and found[i]["text"] == text
    assert html_text.extract(pages(spark, [])).count() == 0
    clash = pages(spark, [(1, "u", PAGE)]).drop("payload", "key").withColumns({"text": F.lit(5), "n_chars": F.lit("x"), "hint": F.lit(1)})
    assert {k: v for k, v in html_text.extract(clash).first().asDict().items() if k != "html"} == {"page_id": 1, "url": "u", "hint": 1, "text": expected, "n_chars": len(expected)}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES)))
def test_query_columns(spark, name):
    """Queries run over the smallest tables and give one row a document, page or vector, or the ranks."""
    df = queries.QUERIES[name](spark, SF)
    n = df.count()
    source = {"op3": "embeddings", "op6": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    if name.startswith("op12"):  # ranks of positives that have negatives
        assert 0 < n <= 5 * 5 * 10 and df.select("anchor_id", "positive_id", "rank").distinct().count() == n
        return
    assert n == (50 if name.startswith("op9") else spark.read.parquet(f"{SF}/{source}.parquet").count())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    value = lambda x: round(float(x), 6) if isinstance(x, float) else x
    expected = sorted((tuple(map(value, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(map(value, r)) for r in queries.QUERIES[name](spark, SF).select(names).collect()), key=repr) == expected


def test_language_held_out(spark):
    found = queries.QUERIES["op4_language_id"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    right, n = found.agg(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count("*")).first()
    assert n > 20 and right / n >= 0.98
