"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

The index is built once and written to the shared folder, in blocks of bounded size. In a
block every dimension has its vectors in posting segments, one for each of LEVELS
quantised impacts. A query takes the segments of all dimensions by descending
contribution (its own component times the segment's impact) and adds to each posting's
accumulator what the segment contributes at least. Upper bounds follow from what any
segment not yet read could add and from the width of the levels. The scan stops
only when these bounds prove that no more than a few vectors can still be among
the k best; all of those are then scored exactly from their components. A task holds
some blocks and reads all queries; each query's k-th score so far is where the scan of the next block starts.

Edge cases: vectors that are null or hold null or non-finite components take no
part; vectors of different length never meet; ties go to the smaller id; with
fewer than k candidates all are returned; rows that share an id are candidates of
their own, but none of them answers a query of that id; query rows that share id and
vector ask once, those that share only the id ask each for themselves; an empty table gives
no rows; columns other than the two named are not read, so their names never clash.
Components so large that sums may leave 2**53 are scored in whole numbers of any size, and a score among the
k best that no long holds is an error, not a wrong number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import dealt
from nearfield.runtime import materialize, prepare

LEVELS = 32
STEP = 256  # segments read between two looks at the bounds
EXACT = 1 << 53  # whole numbers below it are exact as doubles


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


class ImpactIndex:
    """One block: vectors of whole numbers, and their postings by dimension and quantised impact."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, postings: np.ndarray | None = None):
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.low = values.min(0) if n and dims else np.zeros(dims, np.int64)
        top = values.max(0) if n and dims else np.zeros(dims, np.int64)
        self.most = int(max(np.abs(self.low).max(initial=0), np.abs(top).max(initial=0)))
        self.width = (top - self.low) // LEVELS + 1
        segment = (np.arange(dims) * LEVELS + (values - self.low) // self.width).T.ravel()
        if postings is None:
            postings = (np.argsort(segment, kind="stable") % max(n, 1)).astype(np.int32)
        self.postings = postings
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(segment, minlength=dims * LEVELS))))

    def search(self, query: np.ndarray, k: int, skip: int | None, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in this block and exact scores of its k best vectors, best first; vectors
        that score less than floor may be left out."""
        n, dims = self.values.shape
        own = self.ids == skip if skip is not None else np.zeros(n, bool)
        if dims == 0 or n - own.sum() <= k and floor is None:
            possible = np.flatnonzero(~own)
        else:
            possible = self._possible(query, k, own, floor)
        scores = self.values[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return possible[best], scores[best]

    def _possible(self, query: np.ndarray, k: int, own: np.ndarray, floor: int | None = None) -> np.ndarray:
        n, dims = self.values.shape
        dim = np.repeat(np.arange(dims), LEVELS)
        level = np.tile(np.arange(LEVELS), dims)
        slope = np.abs(query)
        # What a segment adds at least and at most, above the least that its dimension can add.
        rank = np.where(query[dim] >= 0, level, LEVELS - 1 - level)
        least = slope[dim] * self.width[dim] * rank
        most = least + slope[dim] * (self.width[dim] - 1)
        base = int((query * np.where(query >= 0, self.low, self.low + LEVELS * self.width - 1)).sum())
        order = np.lexsort((dim, -most))
        order = order[self.bounds[order + 1] > self.bounds[order]]
        # By dimension, the most that the segments from a place in the order on can add.
        sums = np.zeros(n, np.int64)
        error = int((slope * (self.width - 1)).sum())
        enough = max(4 * k, n // 32)
        remaining = np.zeros(dims, np.int64)

        def bound() -> int:
            local = np.partition(np.where(own, -1, sums), n - k)[n - k] if n > k else -1
            return int(local) if floor is None else max(int(local), floor - base)

        for i in range(0, len(order), STEP):
            step = order[i : i + STEP]
            spans = [self.postings[self.bounds[s] : self.bounds[s + 1]] for s in step]
            hit = np.concatenate(spans)
            add = np.repeat(least[step], [len(x) for x in spans])
            sums += np.bincount(hit, add, n).astype(np.int64)
            rest = order[i + STEP :]
            if not len(rest):
                break
            if i % (2 * STEP) == 0:
                remaining[:] = 0
                np.maximum.at(remaining, dim[rest], most[rest])
                possible = np.flatnonzero(~own & (sums + error + int(remaining.sum()) >= bound()))
                if len(possible) <= enough:
                    return possible
        return np.flatnonzero(~own & (sums + error >= bound()))


def _scored_wide(ids: np.ndarray, values: np.ndarray, query: np.ndarray, k: int, skip: int) -> list[tuple[int, int]]:
    """(score, id) of the k best, in whole numbers of any size."""
    whole = [int(x) for x in query]
    found = [(sum(int(x) * y for x, y in zip(row, whole)), int(i)) for i, row in zip(ids, values) if i != skip]
    return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def _values(group: pa.Table) -> np.ndarray:
    return group["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), group["dims"][0].as_py())


def _indexed(group: pa.Table) -> tuple:
    """(ids, components, postings); no postings where components are too large for them."""
    ids, values = group["id"].to_numpy().astype(np.int64), _values(group)
    if np.abs(values).max(initial=0) >= EXACT:
        return ids, values, None
    return ids, values.astype(np.int64), ImpactIndex(ids, values.astype(np.int64)).postings


def _loaded(block: tuple) -> tuple:
    ids, values, postings = block
    return ids, values, None if postings is None else ImpactIndex(ids, values, postings)


def _asked(group: pa.Table) -> tuple:
    return group["tag"].to_pylist(), group["id"].to_pylist(), _values(group)


def _answer(k: int):
    """Rows (tag, query_id, vec_id, score): the k best of a task's blocks for each query. The k-th score so far is where the
    scan of the next block starts."""

    def run(index: list, block: tuple) -> list[tuple]:
        out = []
        for tag, own, query in zip(*block):
            best: list[tuple] = []
            size = float(np.abs(query).sum())
            for ids, values, postings in index:
                # Sums of bounds and of products both stay below 2**53.
                if postings is not None and 4.0 * size * (postings.most + LEVELS) < EXACT:
                    place, score = postings.search(query.astype(np.int64), k, own, best[-1][0] if len(best) == k else None)
                    new = list(zip(score.tolist(), ids[place].tolist()))
                else:
                    new = _scored_wide(ids, values, query, k, own)
                best = sorted(best + new, key=lambda f: (-f[0], f[1]))[:k]
            if any(abs(s) >= 1 << 63 for s, _ in best):
                raise OverflowError("a score among the k best does not fit into a long")
            out += [(tag, own, i, s) for s, i in best]
        return out

    return run


def _whole(df: DataFrame, vec_id: str, vector: str, scale: int, keep: list[str] = []) -> DataFrame:
    """(id, values, *keep, dims): whole numbers as doubles, which hold any floor(scale * component) exactly."""
    # floor() of a double saturates as a long; from 2**52 on a double is whole anyway.
    whole = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < float(1 << 52), F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    rows = df.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), whole.alias("values"), *keep)
    return rows.withColumn("dims", F.size("values"))


def top_k(corpus: DataFrame, queries: DataFrame, k: int, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query row the k rows of corpus with the largest inner product of
    floor(scale * component), other than the query's own id: (query_id, rank, vec_id, score).

    The index is dealt to tasks once; the blocks of queries pass by every task, whose k best a query are merged by a
    ranking window. Queries are written first, with a number each, so a task that is lost and rerun sees the same ones.
    """
    spark = prepare(corpus.sparkSession)
    rows = _whole(corpus, vec_id, vector, scale)
    asked = materialize(_whole(queries, vec_id, vector, scale).distinct().withColumn("tag", F.monotonically_increasing_id()), "queries")
    n, dims = rows.agg(F.count("*"), F.max("dims")).first()
    blocks, parts, query_blocks = dealt.counts(n, dims or 1, asked.count(), spark.sparkContext.defaultParallelism, 24)
    index = materialize(dealt.packed(rows, blocks, _indexed), "index")
    found = dealt.meet(index, dealt.packed(asked, query_blocks, _asked), blocks, parts, _answer(k), "tag long, query_id long, vec_id long, score long", _loaded)
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
