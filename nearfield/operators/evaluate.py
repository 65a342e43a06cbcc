"""Recall, latency statistics and Pareto frontiers as DataFrame aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.running import maximum_before


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (recall): the share of the k true neighbours that were found, averaged over queries."""
    t = truth.where(F.col("rank") <= k).select("query_id", "id")
    hit = t.join(found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall")).agg(F.avg("recall").alias("recall"))


def latency_stats(samples: DataFrame, value: str = "value") -> DataFrame:
    """Mean, population deviation, extremes, and nearest-rank percentiles."""
    v = F.col(value)
    parts = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))]
    return samples.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"), *parts)


def histogram(samples: DataFrame, low: float, high: float, buckets: int, value: str = "value") -> DataFrame:
    """Rows (bucket, n, cdf): counts in equal buckets, 0 and buckets + 1 holding what lies outside."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("bucket"))  # one row a bucket
    return counts.withColumn("cdf", running / F.sum("n").over(Window.partitionBy()))


def pareto(points: DataFrame, x: str = "recall", y: str = "qps") -> DataFrame:
    """The rows that no other row beats in one and equals or beats in the other; rows with a null are beaten by none and beat none.

    Of equal x only the largest y can stay, and it does if it is above all y of larger x: a running maximum from the
    largest x down, one row an x."""
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    best = points.where(whole).groupBy(F.col(x).alias("_x")).agg(F.max(y).alias("_y"))
    above = maximum_before(best, F.desc("_x"), "_y", "_above").where("_above is null or _y > _above")
    kept = points.join(above.select(F.col("_x").alias(x), F.col("_y").alias(y)), [x, y], "left_semi")
    return kept.select(points.columns).unionByName(points.where(~whole))


class Metrics:
    """Counters and a ten-bucket histogram of an index's operations, kept on the driver and never saved."""

    BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 50.0, 250.0)  # milliseconds

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.buckets = [0] * 10

    def record(self, kind: str, milliseconds: float | None = None, n: int = 1) -> None:
        self.counts[kind] = self.counts.get(kind, 0) + n
        if milliseconds is not None:
            self.buckets[sum(milliseconds > b for b in self.BOUNDS)] += 1

    def percentile(self, p: float) -> float:
        """The midpoint of the bucket that holds the percentile."""
        total, so_far = sum(self.buckets), 0
        edges = (0.0, *self.BOUNDS, 2 * self.BOUNDS[-1])
        for i, n in enumerate(self.buckets):
            so_far += n
            if total and so_far >= p * total:
                return (edges[i] + edges[i + 1]) / 2
        return 0.0
