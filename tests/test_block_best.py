"""The k best of a block by products of single precision, against all distances in double precision."""

import numpy as np
import pyarrow as pa
import pytest

from nearfield.operators.knn import block_best, exact_distances


def plain(queries, rows, ids, k, metric):
    out = []
    for i, query in enumerate(queries):
        d = exact_distances(query, rows, metric)
        out += [(i, int(j), d[j]) for j in np.lexsort((ids, d))[:k] if not np.isnan(d[j])]
    return out


def cases():
    r = np.random.default_rng(5)
    usual = r.normal(size=(3000, 24))
    yield "usual", usual[:70], usual
    yield "far from zero", usual[:20] * 1e-3 + 1e3, usual * 1e-3 + 1e3
    yield "copies", usual[:20], np.repeat(usual[:30], 80, axis=0)
    yield "one direction", usual[:20], usual[:1] * np.arange(1, 900)[:, None]
    yield "zeros", np.vstack([usual[:9], np.zeros((2, 24))]), np.vstack([usual[:500], np.zeros((40, 24))])
    yield "tiny", usual[:9] * 1e-7, usual[:900] * 1e-7
    yield "one large", usual[:9], np.vstack([usual[:900], usual[:1] * 1e12])
    yield "too large", usual[:9] * 1e20, usual[:900] * 1e20
    yield "not finite", usual[:9], np.vstack([usual[:900], np.full((1, 24), np.nan)])
    yield "few", usual[:9], usual[:4]


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product", "hamming"])
@pytest.mark.parametrize("name, queries, rows", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_block_best(name, queries, rows, metric):
    ids = np.random.default_rng(6).permutation(len(rows))
    for k in (1, 10, 90):
        place, row, distance = block_best(queries, rows, pa.array(ids), k, metric)
        assert list(zip(place.tolist(), row.tolist(), distance.tolist())) == plain(queries, rows, ids, k, metric)
