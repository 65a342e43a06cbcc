"""Hard negatives against all pairs compared, in whole numbers of Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import dealt, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k_pos, k_neg, low, high, scale):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and None not in v and all(map(math.isfinite, v)):
            good.append((i, [math.floor(scale * float(np.float32(x))) for x in v], str(label)))
    out = []
    for i, v, label in {(i, tuple(v), x) for i, v, x in good if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, x) for j, w, x in good if j != i and len(w) == len(v))
        for s, j, _ in [r for r in scored if r[2] == label][:k_pos]:
            fit = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:k_neg]
            out += [(i, j, n + 1, m, -s, -t) for n, (t, m, _) in enumerate(fit)]
    return sorted(out)


def vectors(seed=1, n=400, dims=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dims))
    rows = [(i, [float(x) for x in centers[rng.integers(4)] + 0.4 * rng.normal(size=dims)], int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rows[i % 7][1], rows[i % 7][2] if i % 2 else None) for i in range(30)]  # copies
    rows += [(n + 40, None, 1), (n + 41, [float("nan")] + [0.0] * (dims - 1), 1), (n + 42, [None] + [0.0] * (dims - 1), 1), (n + 43, [1.0] * 3, 1), (n + 50, [1.0, 2.0, 0.0], 1), (None, [1.0] * dims, 1)]
    return rows + [(n + 60, [0.0] * dims, 0), (n + 70, [0.0] * dims, 0), (n + 80, [], 1), (n + 90, [], 2), (0, rows[0][1], rows[0][2]), (0, rows[1][1], rows[1][2])]


@pytest.mark.parametrize("block,least,cells,chunk", [(4096, 512, 64, 64), (40, 10, 4, 3), (64, 64, 64, 7)])
def test_all_pairs(spark, monkeypatch, block, least, cells, chunk):
    for module, name, value in ((dealt, "BLOCK", block), (dealt, "LEAST", least), (dealt, "QUERIES", 16), (dealt, "PART_BYTES", 8000), (hard_negatives, "CELLS", cells), (hard_negatives, "CHUNK", chunk), (hard_negatives, "ROWS", 50)):
        monkeypatch.setattr(module, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit("7") for c in ("id", "values", "block", "part", "score", "tag", "dims", "asks")})
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, 3, 4, 30, 90)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 10, 3, 4, 30, 90, 256)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_empty_large_and_ties(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    one = [(0, [1.0], 1), (1, [2.0], 1), (2, [1.5], 0)]
    for rows in (one, one * 3, [(0, [1.0], 1), (2, [1.5], 0)], [(5, [1.0], 1), (6, [1.0], 2)]):
        found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, low=10)
        assert sorted(tuple(r) for r in found.collect()) == plain(rows, 10, 5, 10, 10, 90, 256)
    # Whole numbers beyond 2**53 are exact; what no long holds is an error.
    large = [(0, [2.0**-8, 0.0], 1), (1, [2.0**54, 1.0], 1), (2, [2.0**53, 5.0], 0), (3, [2.0**53 * 1.5, 5.0], 2)]
    found = hard_negatives.mine(spark.createDataFrame(large, SCHEMA), F.col("vec_id") == 0)
    assert sorted(tuple(r) for r in found.collect()) == plain(large, 4, 5, 10, 30, 90, 256) == [(0, 1, 1, 3, 2**62, 3 * 2**60), (0, 1, 2, 2, 2**62, 2**61)]
    with pytest.raises(Exception, match="does not fit"):
        hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1e30], 1)], SCHEMA), F.col("vec_id") == 0).collect()


def test_bounds_hold_and_spare_rows():
    rng = np.random.default_rng(2)
    values = np.floor(256 * rng.normal(size=(3000, 16)) / 4)
    labels = np.array([str(x) for x in rng.integers(3, size=3000)])
    block = hard_negatives.Approximation(np.arange(3000), labels, values)
    anchors = np.floor(256 * rng.normal(size=(5, 16)) / 4)
    lower, upper = block.bounds(0, 3000, anchors)
    exact = block.values.astype(float) @ anchors.T
    assert (lower <= exact).all() and (exact <= upper).all() and block.values.dtype == np.int16
    best = [[[]] for _ in anchors]
    scored = block.search(0, 3000, np.full(5, -1), anchors, [[(-np.inf, np.inf)]] * 5, 5, best)
    assert scored < 5 * 3000 / 10
    assert [[-s for s, _ in b[0]] for b in best] == [sorted(exact[:, j], reverse=True)[:5] for j in range(5)]
