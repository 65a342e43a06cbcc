"""Running sums over a global order, without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.runtime import materialize, prepare


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds, for each out: value of sums (whole numbers), the sum of value over all rows up to
    and with this one. The order must be total. Rows are range-partitioned and sorted; each partition sums its own
    rows, and the partitions' totals, one row a partition, give the offsets."""
    spark = prepare(df.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    outs, values = list(sums), list(sums.values())
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(outs, 0)
        for batch in batches:
            added = []
            for out, value in zip(outs, values):
                total = np.cumsum(batch.column(batch.schema.names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)) + so_far[out]
                so_far[out] = int(total[-1]) if len(total) else so_far[out]
                added.append(pa.array(total, pa.int64()))
            yield pa.RecordBatch.from_arrays(batch.columns + added, batch.schema.names + outs)

    schema = T.StructType(ranged.schema.fields + [T.StructField(o, T.LongType()) for o in outs])
    local = materialize(ranged.mapInArrow(run, schema), name)
    totals = local.groupBy("_part").agg(*[F.max(o).alias(o) for o in outs]).orderBy("_part").collect()  # at most one row a partition
    rows, offsets = [], dict.fromkeys(outs, 0)
    for r in totals:
        rows.append((r["_part"], *(offsets[o] for o in outs)))
        offsets = {o: offsets[o] + r[o] for o in outs}
    if not rows:
        return local.drop("_part")
    shift = spark.createDataFrame(rows, T.StructType([T.StructField("_part", T.IntegerType()), *(T.StructField(f"_{o}", T.LongType()) for o in outs)]))
    joined = local.join(F.broadcast(shift), "_part")
    return joined.withColumns({o: F.col(o) + F.col(f"_{o}") for o in outs}).drop("_part", *(f"_{o}" for o in outs))
