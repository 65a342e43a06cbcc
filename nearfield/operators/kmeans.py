"""k-means: fitted on a bounded sample, every row assigned where it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.knn import matrix, pairwise
from nearfield.plans.config import ConstructionFailed
from nearfield.runtime import prepare


def sample(corpus: DataFrame, rows: int, seed: int = 42, total: int | None = None) -> np.ndarray:
    """About rows vectors, by a hash of the id, so reruns agree. rows bounds what the driver gets. total: the corpus's rows, if they are known."""
    total = corpus.count() if total is None else total
    share = min(1.0, rows / max(total, 1))
    picked = corpus.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(share * (1 << 30))).select("id", "vector").orderBy("id").limit(2 * rows)
    return matrix(picked.toArrow()["vector"])


def fit(points: np.ndarray, k: int, iterations: int = 20, metric: str = "l2", seed: int = 42) -> np.ndarray:
    """k-means++ and Lloyd until no point changes its centroid. A centroid without points stays
    where it is; of equal distances the lower number wins."""
    if len(points) == 0 or k < 1:
        raise ConstructionFailed("k-means needs points and at least one centroid")
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    chosen = [int(rng.integers(len(points)))]
    nearest = pairwise(points[chosen], points, metric)[0]
    for _ in range(1, k):
        weight = np.maximum(nearest, 0)
        total = weight.sum()
        pick = int(np.searchsorted(np.cumsum(weight), rng.random() * total)) if total > 0 else int(rng.integers(len(points)))
        chosen.append(min(pick, len(points) - 1))
        nearest = np.minimum(nearest, pairwise(points[chosen[-1:]], points, metric)[0])
    centroids, labels = points[chosen].copy(), None
    for _ in range(iterations):
        new = pairwise(points, centroids, metric).argmin(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        sums = np.zeros_like(centroids)
        np.add.at(sums, labels, points)
        sizes = np.bincount(labels, minlength=k)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
    return centroids


def fit_on(corpus: DataFrame, k: int, rows: int = 16_384, iterations: int = 20, metric: str = "l2", seed: int = 42) -> np.ndarray:
    return fit(sample(corpus, rows, seed), k, iterations, metric, seed)


def refine(corpus: DataFrame, centroids: np.ndarray, metric: str = "l2") -> np.ndarray:
    """One Lloyd step over all rows: each task sends one partial sum a centroid."""
    spark = prepare(corpus.sparkSession)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, sizes = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column(0))
                labels = pairwise(points, c, metric).argmin(1)
                np.add.at(sums, labels, points)
                sizes += np.bincount(labels, minlength=len(c))
        full = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sizes[full]), pa.array(list(sums[full]), pa.list_(pa.float64()))], ["list_id", "n", "sums"])

    parts = corpus.select("vector").mapInArrow(run, "list_id int, n long, sums array<double>")
    cells = parts.select("list_id", "n", F.posexplode("sums").alias("place", "part")).groupBy("list_id", "place").agg(F.sum("part").alias("part"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in cells.collect():  # one row a centroid and dimension
        out[r["list_id"], r["place"]] = r["part"] / r["n"]
    return out


def assign(corpus: DataFrame, centroids: np.ndarray, metric: str = "l2", out: str = "list_id") -> DataFrame:
    """Adds the number of the nearest centroid to every row."""
    spark = prepare(corpus.sparkSession)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(batch.schema.names.index("vector")))
            label = pairwise(rows, shared.value, metric).argmin(1) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.int32())], [*batch.schema.names, out])

    return corpus.mapInArrow(run, T.StructType([*corpus.schema.fields, T.StructField(out, T.IntegerType())]))


def centroid_means(corpus: DataFrame, key: str) -> DataFrame:
    """Rows (key, vector): the mean vector of each group, one dimension at a time, with partial sums before the shuffle."""
    parts = corpus.select(key, F.posexplode("vector").alias("place", "x")).groupBy(key, "place").agg(F.avg("x").alias("x"))
    packed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("cells"))  # one cell a dimension
    return packed.select(key, F.transform("cells", lambda c: c["x"]).alias("vector"))


def list_sizes(assigned: DataFrame, key: str = "list_id") -> DataFrame:
    """Rows (list, size, offset): the inverted lists' sizes and where each starts."""
    from pyspark.sql import Window

    sizes = assigned.groupBy(key).agg(F.count("*").alias("size"))
    return sizes.withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
