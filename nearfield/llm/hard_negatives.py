"""Hard negatives by a vector-approximation file.

The rows are written once as an index of blocks. In a block every dimension is cut into up to CELLS cells that hold about
equally many of its rows; a row's approximation is one byte a dimension, and the file knows the least and the largest
component of each cell. For an anchor, two small tables a dimension (its component times either end of each cell) give, summed
by lookup over a row's bytes, a lower and an upper bound of the row's score. Only rows whose bounds leave it
possible that they are among the best k of a window are scored exactly.

Two passes over the same index: the first finds each anchor's positives, rows of its label; the second finds, for each
positive, the best rows of other labels whose score lies in the window that the positive's score spans. The index does
not move between tasks, anchors and their k best rows do (`dealt.meet`).

Edge cases: rows with a null id or label, a null vector, or null or non-finite components take no part; vectors of
different length never meet; ties go to the smaller id; with fewer than k rows all are returned; anchors without a
positive, and positives with an empty window, give no rows; rows that share an id are rows of their own, but none of them
is a positive or negative of an anchor of that id; anchor rows that share id, label and vector ask once; an empty table
gives no rows; columns other than the three named are not read, so their names never clash. Components so large that sums may leave
2**53 are scored in whole numbers of any size, and a result that no long holds is an error, not a wrong number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import dealt
from nearfield.llm.topk import EXACT, _whole
from nearfield.runtime import materialize, prepare

CELLS = 64
CHUNK = 64  # anchors whose bounds are looked up together
ROWS = 4096  # rows of the same


def cells(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one dimension: each row's cell, and the least and the largest component of every cell."""
    ranked = np.sort(column)
    cuts = np.unique(ranked[np.arange(1, CELLS) * len(ranked) // CELLS])
    cuts = cuts[cuts > ranked[0]]
    edges = np.concatenate(([0], np.searchsorted(ranked, cuts), [len(ranked)]))
    low, high = np.zeros(CELLS), np.zeros(CELLS)
    low[: len(edges) - 1], high[: len(edges) - 1] = ranked[edges[:-1]], ranked[edges[1:] - 1]
    return np.searchsorted(cuts, column, "right").astype(np.uint8), low, high


def smallest(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    most = np.abs(values).max(initial=0)
    return values.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


class Approximation:
    """One block of the file: rows in order of label, their cells dimension by dimension, and the exact components."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, values = ids[order], values[order]
        self.labels, starts = np.unique(labels[order], return_index=True)
        self.starts = np.append(starts, len(ids))
        found = [cells(values[:, d]) for d in range(values.shape[1])]
        self.codes = np.stack([f[0] for f in found]) if found else np.zeros((0, len(ids)), np.uint8)
        self.low, self.high = (np.stack([f[i] for f in found]) if found else np.zeros((0, CELLS)) for i in (1, 2))
        self.most = float(np.abs(values).max(initial=0))
        self.values = smallest(values)

    def slices(self, label: str, same: bool) -> list[tuple[int, int]]:
        """The rows of the label, or all others."""
        at = int(np.searchsorted(self.labels, label))
        here = at < len(self.labels) and self.labels[at] == label
        a, b = (int(self.starts[at]), int(self.starts[at + 1])) if here else (0, 0)
        return [(x, y) for x, y in ([(a, b)] if same else [(0, a), (b, len(self.ids))]) if y > x]

    def bounds(self, a: int, b: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of rows a to b, rows x anchors."""
        shape = b - a, len(anchors)
        kind = np.int32 if self.most * np.abs(anchors).sum(1).max(initial=0) < 1 << 30 else np.float64
        lower, upper, part = np.zeros(shape, kind), np.zeros(shape, kind), np.empty(shape, kind)
        for d in range(len(self.codes)):
            ends = np.multiply.outer(self.low[d], anchors[:, d]), np.multiply.outer(self.high[d], anchors[:, d])
            cell = self.codes[d, a:b].astype(np.intp)
            lower += np.take(np.minimum(*ends).astype(kind), cell, 0, part, "clip")
            upper += np.take(np.maximum(*ends).astype(kind), cell, 0, part, "clip")
        return lower, upper

    def search(self, a: int, b: int, ids: np.ndarray, anchors: np.ndarray, windows: list[list[tuple]], k: int, best: list[list[list[tuple]]]) -> int:
        """Adds rows a to b to best[anchor][window], lists of (-score, id), in order and at most k. windows: for each
        anchor pairs of the least and the largest score. Returns how many rows were scored exactly."""
        size = float(np.abs(anchors).sum(1).max(initial=0))
        if size * self.most >= EXACT:
            place, row = (x.ravel() for x in np.indices((len(anchors), b - a)))
            whole = self.values[a:b].astype(object), anchors.astype(object)
            to_int = np.vectorize(int, otypes=[object])
            scores = [sum(x * y for x, y in zip(u, v)) for v in to_int(whole[1]) for u in to_int(whole[0])] if len(row) else []
        else:
            lower, upper = self.bounds(a, b, anchors)
            free = self.ids[a:b, None] != ids
            possible = np.zeros(lower.shape, bool)
            spans = np.array(windows, float)
            for w in range(spans.shape[1]):
                least, most = spans[:, w, 0], spans[:, w, 1]
                known = np.array([-float(h[w][-1][0]) if len(h[w]) == k else -np.inf for h in best])
                if len(lower) > k:  # the k-th best lower bound of rows that are surely in the window
                    sure = np.where((lower >= least) & (upper <= most) & free, lower, -np.inf)
                    known = np.maximum(known, np.partition(sure, len(sure) - k, axis=0)[len(sure) - k])
                possible |= (upper >= np.maximum(known, least)) & (lower <= most)
            row, place = np.nonzero(possible & free)
            scores = np.concatenate([np.zeros(0), *((self.values[a + row[i : i + 65536]].astype(np.float64) * anchors[place[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536))])
            order = np.argsort(place, kind="stable")
            place, row, scores = place[order], row[order], scores[order].astype(np.int64).tolist()
        found = self.ids[a + row].tolist()
        cuts = np.searchsorted(place, np.arange(len(anchors) + 1))
        for j in range(len(anchors)):
            new = [(-s, i) for s, i in zip(scores[cuts[j] : cuts[j + 1]], found[cuts[j] : cuts[j + 1]]) if i != ids[j]]
            for w, (least, most) in enumerate(windows[j]) if new else ():
                best[j][w] = sorted(best[j][w] + [n for n in new if least <= -n[0] <= most])[:k]
        return len(found)


def _values(group: pa.Table) -> np.ndarray:
    return group["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), group["dims"][0].as_py())


def _indexed(group: pa.Table) -> tuple:
    return (Approximation(group["id"].to_numpy(), np.array(group["label"].to_pylist()), _values(group)),)


def _asked(group: pa.Table) -> tuple:
    group = group.sort_by([("label", "ascending"), ("tag", "ascending")])
    return group["tag"].to_numpy(), group["id"].to_numpy(), group["label"].to_pylist(), _values(group), group["positives"].to_pylist()


def _answer(k: int, low: int, high: int):
    """Rows (tag, slot, anchor_id, positive_id, positive_score, id, score): without positives those of the anchor's label, else
    those of other labels, for each positive."""

    def run(index: list, block: tuple) -> list[tuple]:
        tags, ids, labels, values, positives = block
        out: list[tuple] = []
        starts = [i for i in range(len(labels)) if not i or labels[i] != labels[i - 1]]
        for start, end in zip(starts, [*starts[1:], len(labels)]):
            for a in range(start, end, CHUNK):
                b = min(a + CHUNK, end)
                slots = max(1, max(len(p or ()) for p in positives[a:b]))
                every, nothing = (-np.inf, np.inf), (np.inf, -np.inf)
                spans = [[every] if held is None else [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in held] for held in positives[a:b]]
                windows = [s + [nothing] * (slots - len(s)) for s in spans]
                best: list[list[list[tuple]]] = [[[] for _ in range(slots)] for _ in range(b - a)]
                for (approximation,) in index:
                    for x, y in approximation.slices(labels[a], positives[a] is None):
                        for z in range(x, y, ROWS):
                            approximation.search(z, min(z + ROWS, y), ids[a:b], values[a:b], windows, k, best)
                for j, held in enumerate(best):
                    for w, rows in enumerate(held):
                        p = (positives[a + j] or [{"id": None, "score": None}] * slots)[w] if rows else None
                        out += [(int(tags[a + j]), w, int(ids[a + j]), p["id"], p["score"], i, -s) for s, i in rows]
        if any(abs(r[-1]) >= 1 << 63 for r in out):
            raise OverflowError("a score among the k best does not fit into a long")
        return out

    return run


FOUND = "tag long, slot int, anchor_id long, positive_id long, positive_score long, id long, score long"


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row that anchors names,
    its best rows of the same label are positives, and for each the best rows of other labels whose score is low to high percent of
    the positive's. Scores are inner products of floor(scale * component)."""
    spark = prepare(df.sparkSession)
    # The struct keeps what is read apart from other columns of any name.
    used = df.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("values"), F.coalesce(anchors, F.lit(False)).alias("asks")).where("label is not null")
    rows = _whole(used, "id", "values", scale, keep=["label", "asks"])
    asked = materialize(rows.where("asks").select("id", "label", "values", "dims").distinct().withColumn("tag", F.monotonically_increasing_id()), "anchors")
    n, dims = rows.agg(F.count("*"), F.max("dims")).first()
    blocks, parts, query_blocks = dealt.counts(n, dims or 1, asked.count(), spark.sparkContext.defaultParallelism)
    index = materialize(dealt.packed(rows, blocks, _indexed), "approximations")

    def pass_by(queries: DataFrame, k: int) -> DataFrame:
        sent = dealt.packed(queries, query_blocks, _asked)
        found = dealt.meet(index, sent, blocks, parts, _answer(k, low, high), FOUND)
        rank = F.row_number().over(Window.partitionBy("tag", "slot").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    near = pass_by(asked.select("*", none), positives)
    held = near.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # as many as positives
    second = materialize(asked.join(held, "tag").select(*asked.columns, F.transform("found", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives")), "positives")
    return pass_by(second, negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
