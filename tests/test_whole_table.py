"""Queries over the whole table against brute force: nothing of it is left out."""

import os

import numpy as np
import pytest
from test_vectors import brute

from nearfield import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def table(spark):
    rows = queries.corpus(spark, DATA).orderBy("id").collect()
    return [r["id"] for r in rows], np.array([r["vector"] for r in rows])


@pytest.fixture(scope="module")
def neighbours(table):
    """The eight nearest other rows of every row, by brute force."""
    ids, rows = table
    out = {}
    for i, x in enumerate(rows):
        at, d = brute(x, rows, 9, "l2")
        out[ids[i]] = [(ids[j], e) for j, e in zip(at, d) if j != i][:8]
    return out


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", ["knn_graph_edges", "graph_repair"])
def test_graph_of_all_rows(spark, neighbours, name):
    found = {}
    for r in sorted(run(spark, name), key=lambda r: (r["src"], r["slot"])):
        found.setdefault(r["src"], []).append((r["dst"], r["distance"]))
    assert found.keys() == neighbours.keys()
    for src, edges in found.items():
        assert [x for x, _ in edges] == [x for x, _ in neighbours[src]]
        assert [d for _, d in edges] == pytest.approx([d for _, d in neighbours[src]], abs=2e-6)


def test_figures_of_the_whole_graph(spark, neighbours):
    back = {}
    for src, edges in neighbours.items():
        for dst, _ in edges:
            back.setdefault(dst, []).append(src)
    assert {r["dst"]: (r["n"], r["first"]) for r in run(spark, "reverse_edges")} == {k: (len(v), min(v)) for k, v in back.items()}
    mean, src = min((sum(d for _, d in edges) / 8, src) for src, edges in neighbours.items())
    (entry,) = run(spark, "entry_point")
    assert entry["src"] == src and entry["mean"] == pytest.approx(mean, abs=2e-6)
    assert run(spark, "mean_farthest")[0]["mean"] == pytest.approx(np.mean([edges[-1][1] for edges in neighbours.values()]), abs=2e-6)


def test_pruning_of_all_rows(spark, table, neighbours):
    place, rows = {x: i for i, x in enumerate(table[0])}, table[1]
    expected = set()
    for src, edges in neighbours.items():
        kept = []
        for dst, d in edges:
            if not any(((rows[place[dst]] - rows[place[k]]) ** 2).sum() < d for k in kept):
                kept.append(dst)
        expected |= {(src, i, dst) for i, dst in enumerate(kept)}
    assert {(r["src"], r["slot"], r["dst"]) for r in run(spark, "pruned_graph")} == expected


def test_skip_layers_are_exact(spark, table):
    """Every layer's nodes are those of its level or above, each with its nearest others of the layer."""
    from nearfield.operators import graph

    df = queries.corpus(spark, DATA).select("id", "vector")
    level = {r["id"]: r["level"] for r in run(spark, "hnsw_levels")}
    place, rows = {x: i for i, x in enumerate(table[0])}, table[1]
    found = {}
    for r in graph.hnsw_layers(df, 4, 6, "l2").collect():
        found.setdefault((r["layer"], r["src"]), set()).add(r["dst"])
    for layer in range(1, 7):
        nodes = [x for x in table[0] if level[x] >= layer]
        for x in nodes:
            near = sorted((y for y in nodes if y != x), key=lambda y: (((rows[place[x]] - rows[place[y]]) ** 2).sum(), y))[:4]
            assert found.get((layer, x), set()) == set(near)
    assert 0.35 < np.mean([n >= 1 for n in level.values()]) < 0.65


def test_skip_layers_out_of_the_graph(spark, table):
    """Degrees are bounded, every node of a layer has links, and most of them are the nearest of its layer."""
    from nearfield.operators import graph

    df = queries.corpus(spark, DATA).select("id", "vector")
    edges = graph.exact_graph(df, 8, "l2", "kernel")
    layers = graph.layers_of(edges, df, 4, 4, "l2")
    assert "CartesianProduct" not in (plan := layers._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    exact = {(r["layer"], r["src"], r["dst"]) for r in graph.hnsw_layers(df, 4, 4, "l2").collect()}
    found = layers.collect()
    pairs = {(r["layer"], r["src"], r["dst"]) for r in found}
    assert len(pairs) == len(found) and {(a, b) for a, b, _ in pairs} == {(a, b) for a, b, _ in exact}
    degrees = {}
    for a, b, _ in pairs:
        degrees[a, b] = degrees.get((a, b), 0) + 1
    assert max(degrees.values()) <= 4
    for layer in (1, 2):
        assert len({x for x in pairs & exact if x[0] == layer}) > 0.85 * len({x for x in exact if x[0] == layer})


def test_walks_over_all_rows(spark, table):
    ids, rows = table
    found = {}
    for r in run(spark, "beam_search"):
        found.setdefault(r["query_id"], set()).add(r["id"])
    asked = [i for i, x in enumerate(ids) if x % 50 == 0]
    assert found.keys() == {ids[i] for i in asked}
    assert np.mean([len({ids[j] for j in brute(rows[i], rows, 5, "l2")[0]} & found[ids[i]]) / 5 for i in asked]) >= 0.9


@pytest.mark.parametrize("name", ["ivf_flat", "sharded_knn", "ivfpq_knn", "knn_join_blocks_l2", "knn_join_kernel_cosine", "search_beyond_256", "index_lifecycle"])
def test_every_fiftieth_row_asks(spark, table, name):
    assert {r["query_id"] for r in run(spark, name)} == {x for x in table[0] if x % 50 == 0}


@pytest.mark.parametrize("name", ["range_join", "range_join_blocks"])
def test_range_join_has_every_link(spark, table, name):
    ids, rows = table
    expected = {(ids[i], ids[j]) for i in range(len(ids)) if ids[i] % 50 == 0 for j in np.flatnonzero(((rows - rows[i]) ** 2).sum(1) <= 60.0)}
    found = run(spark, name)
    assert {(r["query_id"], r["id"]) for r in found} == expected and len(found) == len(expected) and max(r["rank"] for r in found) > 15


@pytest.mark.parametrize("name,metric", [("ivf_flat", "cosine"), ("sharded_knn", "l2"), ("ivfpq_knn", "l2")])
def test_recall_on_the_table(spark, name, metric):
    """On 2,000 vectors that do not cluster."""
    at = "/root/testdata/sf0.1"
    rows = queries.corpus(spark, at).orderBy("id").collect()
    ids, vectors = [r["id"] for r in rows], np.array([r["vector"] for r in rows])
    found = {}
    for r in queries.QUERIES[name](spark, at).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    recall = np.mean([len({ids[j] for j in brute(vectors[i], vectors, 10, metric)[0]} & found[x]) / 10 for i, x in enumerate(ids) if x % 50 == 0])
    assert recall >= 0.9
