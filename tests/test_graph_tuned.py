"""Graph searches whose settings are measured on the table: vectors that do not cluster, of which the least settings miss too many neighbours."""

import numpy as np
import pytest

from nearfield.operators import graph


@pytest.fixture(scope="module")
def vectors(spark):
    rows = np.random.default_rng(11).normal(size=(500, 40))
    near = [[j for j in np.argsort(((rows - x) ** 2).sum(1)) if j != i] for i, x in enumerate(rows)]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>").repartition(4), near


def share(found, near, k, own):
    """own: a query's own row is one of the k."""
    return np.mean([len({x for x, rank in rows if rank <= k} & {q, *near[q][: k - 1]} if own else {x for x, rank in rows if rank <= k} & set(near[q][:k])) / k for q, rows in found.items()])


def lists(rows, key, rank, value):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append((r[value], r[rank]))
    return out


def test_descent_takes_longer_lists_where_it_must(spark, vectors):
    df, near = vectors
    found = lambda e: lists(((r["src"], r["slot"] + 1, r["dst"]) for r in e.collect()), 0, 1, 2)
    assert share(found(graph.nn_descent(df, 3, "l2", 8)), near, 3, False) < 0.9
    assert share(found(graph.nn_descent(df, 3, "l2", 8, tune=(3, 0.9))), near, 3, False) >= 0.9


def test_walks_start_in_more_parts_where_they_must(spark):
    """Three groups without an edge between them: a walk from one node stays in its group, however long its beam."""
    rng = np.random.default_rng(3)
    rows = np.concatenate([1000.0 * g + rng.normal(size=(24, 6)) for g in range(3)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>")
    near = [[j for j in np.argsort(((rows - x) ** 2).sum(1)) if j != i] for i, x in enumerate(rows)]
    edges = graph.exact_graph(df, 6, "l2", "kernel")
    found = lambda **x: lists(graph.beam_search(df.where("id % 4 = 0"), df, edges, 5, 16, "l2", **x).collect(), "query_id", "rank", "id")
    assert share(found(), near, 5, True) < 0.5
    assert share(found(recall=0.9), near, 5, True) >= 0.9
