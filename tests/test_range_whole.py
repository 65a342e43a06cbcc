"""A range join of very many pairs: ranked where they are found, with the result of the shuffled form."""

import numpy as np
import pytest

from nearfield.operators import knn


@pytest.mark.parametrize("form", ["kernel", "blocks"])
def test_many_pairs_are_not_shuffled(spark, monkeypatch, form):
    rng = np.random.default_rng(9)
    rows = np.concatenate([rng.normal(size=(500, 8)), np.repeat(rng.normal(size=(5, 8)), 20, axis=0)])  # copies tie
    df = spark.createDataFrame([(f"n{i}", x.tolist()) for i, x in enumerate(rows)], "id string, vector array<double>").repartition(4)
    asked = df.where("substr(id, -1) in ('3', '7')")
    get = lambda df: sorted(tuple(r) for r in df.collect())
    shuffled = get(knn.range_join(asked, df, 14.0, "l2", None, form))
    monkeypatch.setattr(knn, "SHUFFLED_PAIRS", 64)
    monkeypatch.setattr(knn, "HELD_PAIRS", 4000)
    found = knn.range_join(asked, df, 14.0, "l2", None, form)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" in plan
    assert get(found) == shuffled and len(shuffled) > 10_000
