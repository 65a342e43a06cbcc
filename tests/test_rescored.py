"""IVF-PQ candidates are computed exactly where they lie: however many they are, only the k best leave a task."""

import numpy as np
import pytest

from nearfield.operators import knn, pq
from nearfield.plans.config import IVFPQConfig


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_rescored(spark, metric):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(900, 16)) * (1 + np.arange(900) % 3)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>").repartition(4)
    asked = df.where("id % 30 = 0")
    index = pq.IVFPQ.train(df, IVFPQConfig(lists=6, nprobe=2, iterations=4, subspaces=4, metric=metric)).add(df)
    get = lambda found: {q: [(i, round(d, 9)) for _, i, d in sorted(x)] for q, x in groups(found)}

    def groups(found):
        out = {}
        for r in found.collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
        return out.items()

    df_found = index.search_rescored(asked, df, 5, 3, 40)
    plan = df_found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Join ") == 1  # the one of codes and vectors; no candidates are ranked before
    found, whole = get(df_found), get(index.search_rescored(asked, df, 5, 6, 900))
    assert whole == get(knn.knn_join(asked, df, 5, metric, "expression"))
    # Nothing of the 40 nearest by their codes is missed.
    short = {q: [i for i, _ in x] for q, x in get(index.search(asked, 40, 3)).items()}
    assert found.keys() == short.keys()
    for q, x in found.items():
        best = sorted(knn.exact_distances(rows[q], rows[short[q]], metric))[:5]
        assert len(x) == 5 and all(d <= b + 1e-8 for (_, d), b in zip(x, best))
