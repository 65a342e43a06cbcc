"""Running maxima over a global order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.runtime import materialize


def maximum_before(df: DataFrame, order: Column, value: str, out: str) -> DataFrame:
    """Adds the largest value of the rows before each row; null for the first. The order must be total. Rows are
    dealt by ranges of the order; each range has its own running maximum, and the ranges' maxima, one row a range, are what came
    before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("_range").agg(F.max(value).alias("_top")).withColumn("_before", F.max("_top").over(before))  # one row a range
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.withColumn("_within", F.max(value).over(within)).join(F.broadcast(tops.select("_range", "_before")), "_range")
    return joined.withColumn(out, F.greatest("_within", "_before")).drop("_range", "_within", "_before")
