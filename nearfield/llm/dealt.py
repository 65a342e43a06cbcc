"""An index that stays where it is while all queries pass by: its blocks are dealt to tasks once, every task holds its own
few and reads the blocks of queries as a stream."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096  # vectors of an index block
LEAST = 512  # vectors of an index block where there are fewer than the cores could share
QUERIES = 512  # of a block of queries
PART_BYTES = 48 << 20  # of an index held by one task, about
PACKED = "dims int, block int, data binary"


def counts(rows: int, dims: int, queries: int, cores: int, width: int = 10) -> tuple[int, int, int]:
    """Numbers of index blocks, of tasks that hold them and of query blocks. width: bytes an index takes a component."""
    blocks = max(1, -(-rows // BLOCK), min(2 * cores, -(-rows // LEAST)))
    held = max(1, PART_BYTES // max(1, BLOCK * dims * width))
    parts = max(1, -(-blocks // held), min(blocks, 2 * cores))
    return blocks, parts, max(1, -(-queries // QUERIES))


def packed(rows: DataFrame, blocks: int, pack: Callable[[pa.Table], tuple]) -> DataFrame:
    """Rows (dims, block, data): what pack makes of the rows of each block. A block follows from a hash of id and values."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "values"), F.lit(blocks)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        data = pickle.dumps(pack(group), protocol=5)
        return pa.table({"dims": group["dims"][:1], "block": group["block"][:1], "data": pa.array([data], pa.binary())})

    return placed.groupBy("dims", "block").applyInArrow(run, PACKED)


def meet(index: DataFrame, queries: DataFrame, blocks: int, parts: int, answer: Callable[[list, object], list[tuple]], schema: str, load: Callable | None = None) -> DataFrame:
    """answer(index blocks of a task, one query block) for every task and query block whose vectors have equal lengths. load: what
    a task makes of an index block once, before it reads queries.

    Index blocks move once, to the one task that holds them; a query block goes to every task. A task reads its index
    blocks first and keeps nothing else, so lost tasks are rerun by themselves.
    """
    part = F.floor(F.col("block").cast("long") * parts / blocks).cast("int")
    held = index.select(part.alias("part"), "dims", (-F.col("block") - 1).alias("place"), "data")
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dims", F.col("block").alias("place"), "data")
    dealt = held.unionByName(sent).repartitionById(parts, F.col("part")).sortWithinPartitions("dims", "place")
    fields = T.StructType.fromDDL(schema)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        last, mine = None, []
        for batch in batches:
            for dims, place, data in zip(*(batch.column(batch.schema.names.index(n)) for n in ("dims", "place", "data"))):
                if dims.as_py() != last:
                    last, mine = dims.as_py(), []
                block = pickle.loads(data.as_buffer())
                if place.as_py() < 0:
                    mine.append(load(block) if load else block)
                elif mine:
                    columns = list(zip(*answer(mine, block))) or [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], names)

    return dealt.mapInArrow(run, schema)
