"""Exact search with an 8-bit prefilter: bounds by small codes, then proof by rescoring.

What the bounds need of a row is derived once and written with it: codes, step, half the sum of their sizes, and the
square of its length, in blocks. A block of queries is coded too; one product of whole numbers (exact in single precision, as they are
small) gives a lower and an upper bound of every distance. A query's k-th upper bound is above its k-th distance, so only rows
whose lower bound is below it are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.distance import TINY
from nearfield.operators.knn import CORPUS_BLOCK, NAMES, QUERY_BLOCK, Best, _order, best_per_query, exact_distances, matrix, packed_rows, sent_queries
from nearfield.plans.config import DimensionMismatch, SearchFailed
from nearfield.plans.planner import BROADCAST_BYTES
from nearfield.runtime import materialize, prepare

EXACT_DIMS = (1 << 24) // (127 * 127)  # up to here single precision holds sums of products of codes


def quantize(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.abs(rows).max(1) / 127 if rows.size else np.ones(len(rows))
    step = np.where(step == 0, 1.0, step)
    codes = np.clip(np.trunc(rows / step[:, None] + np.copysign(0.5, rows)), -127, 127)
    return codes.astype(np.int8), step


def derived(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, steps, half the sums of the codes' sizes, and squared lengths."""
    codes, step = quantize(rows)
    return codes, step, np.abs(codes).sum(1, dtype=np.int64) / 2, (rows**2).sum(1)


def bounded_best(queries: np.ndarray, rows: np.ndarray, kept: tuple, ids: pa.Array, k: int, metric: str, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, row place, distance) of each query's k best rows, and how many distances were computed. kept: derived(rows);
    kth: what no row may exceed."""
    codes, step, mass, square = kept
    u, unit, own_mass, own = derived(queries)
    kind = np.float32 if queries.shape[1] <= EXACT_DIMS else np.float64
    dots = (u.astype(kind) @ codes.T.astype(kind)).astype(np.float64)
    scale = unit[:, None] * step
    dots *= scale
    # Each rounded component is off by half a step at most.
    error = scale * (own_mass[:, None] + mass + queries.shape[1] / 4) * (1 + 1e-6) + 1e-9
    if metric == "inner_product":
        middle, off = -dots, error
    elif metric == "l2":
        middle, off = own[:, None] + square - 2 * dots, 2 * error
    else:
        size = np.sqrt(own)[:, None] * np.sqrt(square)
        zero = size < TINY
        size = np.maximum(size, TINY)
        middle, off = np.where(zero, 1.0, 1 - dots / size), np.where(zero, 0.0, error / size)
    slack = 1e-9 * (1 + np.abs(middle))
    high = middle + off + slack
    worst = np.full(len(queries), np.inf) if kth is None else kth
    if len(rows) > k:
        worst = np.minimum(worst, np.partition(high, k - 1, axis=1)[:, k - 1])
    place, row = np.nonzero(middle - off - slack <= worst[:, None])
    parts = [exact_distances(queries[place[i : i + 65536]], rows[row[i : i + 65536]], metric) for i in range(0, len(place), 65536)]
    d = np.concatenate([np.zeros(0), *parts])
    order = np.lexsort((_order(ids)[row], d, place)) if len(row) else np.zeros(0, np.int64)
    place = place[order]
    first = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[first], row[order[first]], d[order[first]], len(place)


class Bounded:
    """blocks: rows (block, ids, dims, matrix, codes, step, mass, square), written once for all searches."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    @classmethod
    def build(cls, corpus: DataFrame) -> Bounded:
        spark = prepare(corpus.sparkSession)
        count = max(1, -(-corpus.count() // CORPUS_BLOCK), min(spark.sparkContext.defaultParallelism, corpus.count() // 256))
        kind = corpus.schema["id"].dataType.simpleString()

        def run(group: pa.Table) -> pa.Table:
            rows = matrix(group["vector"])
            ids = pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group["id"].combine_chunks())
            names = ("codes", "step", "mass", "square")
            return pa.table({"block": group["block"][:1], "ids": ids, "dims": pa.array([rows.shape[1]], pa.int32()), "matrix": pa.array([rows.astype("<f8").tobytes()], pa.binary()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, derived(rows))}})

        block = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block")
        schema = f"block int, ids array<{kind}>, dims int, matrix binary, codes binary, step binary, mass binary, square binary"
        return cls(materialize(corpus.select(block, "id", "vector").groupBy("block").applyInArrow(run, schema), "bounded"))

    def search(self, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        """The k-NN join; the result is that of the other forms. Queries of a checked size are broadcast to the blocks, more of
        them meet the blocks in a join."""
        if metric == "hamming":
            raise SearchFailed("bits have no 8-bit codes")
        spark = prepare(queries.sparkSession)
        kind = self.blocks.schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])
        n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()

        def block_of(batch: pa.RecordBatch, i: int) -> tuple:
            ids, width, *data = (batch.column(batch.schema.names.index(c))[i] for c in ("ids", "dims", "matrix", "codes", "step", "mass", "square"))
            held, width = ids.values, width.as_py()
            rows, step, mass, square = (np.frombuffer(data[j].as_buffer(), "<f8") for j in (0, 2, 3, 4))
            return held, rows.reshape(len(held), width), (np.frombuffer(data[1].as_buffer(), np.int8).reshape(len(held), width), step, mass, square)

        if n * (dims or 0) * 8 > BROADCAST_BYTES:

            def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        asked = batch.column(batch.schema.names.index("q_rows"))[i].values
                        ids, rows, kept = block_of(batch, i)
                        place, row, d, _ = bounded_best(matrix(asked.field("vector")), rows, kept, ids, k, metric)
                        yield pa.RecordBatch.from_arrays([asked.field("id").take(pa.array(place)), ids.take(pa.array(row)), pa.array(d)], NAMES)

            left = packed_rows(queries.select("id", "vector"), "q", n, QUERY_BLOCK)
            numbers = self.blocks.select("block").distinct()  # one row a block
            met = left.join(F.broadcast(numbers)).join(self.blocks.hint("merge"), "block")
            return best_per_query(met.drop("q", "block").mapInArrow(meet, schema), k)
        shared = spark.sparkContext.broadcast(sent_queries(queries, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, points = shared.value
            best = Best(len(points), k)
            for batch in batches:
                for i in range(batch.num_rows if len(points) else 0):
                    ids, rows, kept = block_of(batch, i)
                    if rows.shape[1] != points.shape[1]:
                        raise DimensionMismatch(rows.shape[1], points.shape[1])
                    for a in range(0, len(points), QUERY_BLOCK):
                        place, row, d, _ = bounded_best(points[a : a + QUERY_BLOCK], rows, kept, ids, k, metric, best.kth[a : a + QUERY_BLOCK])
                        best.add(place + a, ids.take(pa.array(row)), d)
            if best.held:
                place, ids, d = best.rows()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), ids, pa.array(d)], NAMES)

        return best_per_query(self.blocks.drop("block").mapInArrow(run, schema), k)


def knn_join_bounded(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k-NN join with the prefilter, for one search: the corpus is derived and written first."""
    return Bounded.build(corpus).search(queries, k, metric)
