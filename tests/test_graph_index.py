"""Graphs that change: local joins, insertions that link, repairs with a guard."""

import numpy as np
import pytest

from nearfield.operators import graph
from nearfield.operators.graph_index import GraphIndex
from nearfield.plans.config import DimensionMismatch, IdAlreadyExists, IndexEmpty


def frame(spark, rows, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vector array<double>").repartition(3)


def lists(edges):
    out = {}
    for r in sorted(edges.collect(), key=lambda r: (r["src"], r["slot"])):
        out.setdefault(r["src"], []).append(r["dst"])
    return out


def squares(rows):
    return ((rows[:, None] - rows[None]) ** 2).sum(2)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    return rng.normal(size=(12, 10))[np.arange(260) % 12] + 0.5 * rng.normal(size=(260, 10))


@pytest.mark.parametrize("cross,least", [(False, 0.95), (True, 0.85)])
def test_descent_by_local_joins(spark, points, cross, least):
    far = squares(points)
    np.fill_diagonal(far, np.inf)
    found = lists(graph.nn_descent(frame(spark, points), 8, "l2", 8, cross=cross))
    assert set(found) == set(range(260)) and all(len(x) == 8 == len(set(x)) for x in found.values())
    truth = np.argsort(far, 1)[:, :8]
    assert np.mean([len(set(found[i]) & set(truth[i])) / 8 for i in range(260)]) >= least


def test_a_local_join_tries_every_pair_once_fresh(spark):
    rows = np.array([[0.0], [1.0], [3.0], [7.0]])
    members = [("a", 0, True, 0), ("a", 1, False, 0), ("a", 2, False, 1), ("b", 3, True, 0), ("b", 0, False, 1)]
    given = spark.createDataFrame(members, "via string, id long, fresh boolean, side int")
    far = spark.createDataFrame([(0, 2.0)], "id long, far double")
    found = {tuple(r) for r in graph.improving(given, frame(spark, rows), far, 5, "l2").collect()}
    # 1-2 are both old; 0 takes none that is not nearer than 2.
    assert found == {(0, 1, 1.0), (1, 0, 1.0), (2, 0, 9.0), (3, 0, 49.0)}
    crossed = {tuple(r) for r in graph.improving(given, frame(spark, rows), far, 5, "l2", True).collect()}
    assert crossed == {(2, 0, 9.0), (3, 0, 49.0)}


def plain_insert(rows, old, first, n, degree):
    """Each new node's nearest, then every node keeps its best of what it had and of the new nodes that found it."""
    far = squares(rows[: first + n])
    np.fill_diagonal(far, np.inf)
    out = {k: list(v) for k, v in old.items()}
    offered = {}
    for i in range(first, first + n):
        out[i] = sorted(range(first + n), key=lambda j: (far[i, j], j))[:degree]
        for j in out[i]:
            offered.setdefault(j, []).append(i)
    for j, new in offered.items():
        out[j] = sorted({*out[j], *new}, key=lambda i: (far[j, i], i))[:degree]
    return out


def test_insertions_link_the_graph(spark, points, tmp_path):
    path = str(tmp_path / "graph")
    index = GraphIndex.build(frame(spark, points[:200]), 6, "l2", 0, path)
    expected = lists(index.edges())
    for first, n in ((200, 20), (220, 1), (221, 9)):
        before = index._state["edges"]
        index.insert(frame(spark, points[first : first + n], first))
        expected = plain_insert(points, expected, first, n, 6)
        assert lists(index.edges()) == expected
        # A delta holds the touched nodes only, and what was there is not written again.
        assert index._state["edges"][:-1] == before and len({r["src"] for r in spark.read.parquet(f"{path}/{index._state['edges'][-1]}").collect()}) < 100
    again = GraphIndex.load(spark.newSession(), path)
    assert lists(again.edges()) == expected and again.rows().count() == 230 and again.waiting == 30
    for bad, error in ((frame(spark, points[:1]), IdAlreadyExists), (frame(spark, [[1.0]], 900), DimensionMismatch)):
        with pytest.raises(error):
            again.insert(bad)
    assert lists(GraphIndex.load(spark, path).edges()) == expected
    with pytest.raises(IndexEmpty):
        GraphIndex.load(spark, str(tmp_path / "none"))
    found = again.search(frame(spark, points[:5]), 3, 64, 60).where("query_id = id").count()
    assert found == 5


def test_repair_runs_by_itself(spark, points):
    index = GraphIndex.build(frame(spark, points[:100]), 5, "l2", 10)
    for first in range(100, 124, 4):
        index.insert(frame(spark, points[first : first + 4], first))
    assert (index.repairs, index.waiting) == (2, 0)
    index.insert(frame(spark, points[124:130], 124))
    assert (index.repairs, index.waiting) == (2, 6) and len(index._state["edges"]) == 2


def test_repair_mends_and_rolls_back(spark, points):
    df = frame(spark, points[:150])
    exact = lists(graph.exact_graph(df, 6, "l2", "kernel"))
    far = squares(points[:150])
    rng = np.random.default_rng(5)
    spoiled = {i: (sorted(rng.choice([j for j in range(150) if j != i], 6, replace=False).tolist(), key=lambda j: far[i, j]) if i < 10 else x) for i, x in exact.items()}
    edges = spark.createDataFrame([(i, s, j, float(far[i, j])) for i, x in spoiled.items() for s, j in enumerate(x)], "src long, slot int, dst long, distance double")
    changed = df.where("id < 10").select("id")
    share = lambda found: np.mean([len(set(found[i]) & set(exact[i])) / 6 for i in range(10)])
    mended = lists(graph.repair(edges, df, changed, 6, "l2", guard=0.0))
    assert share(spoiled) < 0.2 and share(mended) > 0.9
    # The mean distance of farthest neighbours falls far below what it was: by the guard nothing changes.
    assert lists(graph.repair(edges, df, changed, 6, "l2", guard=1.0)) == spoiled
    # What is right already stays, and nodes that are gone leave all lists.
    assert lists(graph.repair(graph.exact_graph(df, 6, "l2", "kernel"), df, changed, 6, "l2")) == exact
    left = df.where("id >= 3")
    found = lists(graph.repair(graph.exact_graph(df, 6, "l2", "kernel"), left, df.where("id < 3").select("id"), 6, "l2", guard=0.0))
    assert set(found) == set(range(3, 150)) and not any(j < 3 for x in found.values() for j in x)
