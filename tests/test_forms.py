"""Queries of many distances take matrix products, whose results are those of the expressions to the last bit."""

import os

import numpy as np
import pytest

from nearfield import queries
from nearfield.operators import knn

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", ["recall_at_10", "base_delta_search", "knn_join_ip", "knn_join_cosine", "knn_join_l2", "knn_join_hamming"])
def test_many_distances_take_products(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product", "hamming"])
@pytest.mark.parametrize("form", ["kernel", "blocks"])
def test_forms_agree_to_the_last_bit(spark, metric, form):
    """Copies of a few vectors in many lengths: their cosines differ in rounding only, and that decides their ranks."""
    rng = np.random.default_rng(8)
    rows = np.repeat(rng.normal(size=(12, 64)).astype(np.float32).astype(float), 30, axis=0) * (1 + np.arange(360) % 7)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>").repartition(4)
    found = {f: sorted(tuple(r) for r in knn.knn_join(df.where("id % 9 = 0"), df, 10, metric, f).collect()) for f in ("expression", form)}
    assert found[form] == found["expression"]
