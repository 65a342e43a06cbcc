"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one row kept a group.

Equal vectors of a label are one row with a count first. Unit vectors go to the cell of their nearest
centroid and, so that pairs are not lost at a border, to a bounded number of other cells in which a
vector within the threshold could live, the nearest first: two unit vectors
with cosine >= t are at most d = sqrt(2 - 2t) apart, so a partner can be nearer to
centroid b than to its own a only if x.a - x.b <= d * |a - b|. With replicas=None a row goes to all
such cells and no pair is lost, at the price of as many copies of a row as it has such cells;
the README has the measured recall of the bounded form. No two centroids are closer than the
threshold, so a dense group is not scattered over many cells.

A pair is judged where one of its rows is at home; where both homes could judge it, the smaller cell does, so each link
counts once at both ends. The rows of a label in a cell are compared in blocks of bounded size; a block returns counts
and, for each row, one edge to the smallest id of its group in the block. There are about rows / CELL_ROWS
cells, and from a million rows of a label on their square root, so cells always grow with the rows and the broadcast of
centroids only as that root: 50 MB at 64 dimensions and 10,000 million rows. Products of rows and centroids are made in slices of
bounded size, by the k-means on the driver and by the tasks that assign rows.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows without a
label, link with nothing and stay; vectors of different length never link; components of any finite size are
scaled by powers of two first, so that no norm over- or underflows; rows
that share an id are one node of the link graph; an empty table gives no rows; columns other than the three named are
not read, so their names never clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.components import connected_components
from nearfield.llm.topk import usable
from nearfield.runtime import materialize, prepare, scratch

#: The k-means is fitted on at most about so many rows; all rows are assigned.
FIT_ROWS = 16_384
CELL_ROWS = 1024  # rows of one label in a cell, about
BLOCK = 1024
PRODUCTS = 1 << 21  # of rows and centroids made at once, by driver and tasks
REPLICAS = 4  # cells besides its own that a row goes to at most


def cell_count(rows: int) -> int:
    """Cells for a label of so many rows."""
    return max(1, min(-(-rows // CELL_ROWS), math.isqrt(max(rows - 1, 0)) + 1))


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest component is about 1."""
    _, exponent = np.frexp(np.abs(matrix).max(1, initial=0.0, keepdims=True))
    return np.ldexp(matrix, -exponent)


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = scaled(matrix)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def apart(centroids: np.ndarray, threshold: float) -> np.ndarray:
    """The centroids but for those that are within the threshold of one before them."""
    kept: list[int] = []
    for i in range(len(centroids)):
        if not kept or (centroids[kept] @ centroids[i]).max() < threshold:
            kept.append(i)
    return centroids[kept]


def slices(points: np.ndarray, cells: int) -> list[np.ndarray]:
    """The points in slices whose products with all centroids stay small, however many these are."""
    size = max(1, PRODUCTS // max(cells, 1))
    return [points[i : i + size] for i in range(0, len(points), size)]


def cells_of(points: np.ndarray, centers: np.ndarray, reach: float, replicas: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the home of each, and pairs (row, cell) of the cells it goes to, its home among them."""
    homes, rows, goes, done = [], [], [], 0
    for part in slices(points, len(centers)):
        near = part @ centers.T
        home = near.argmax(1)
        gap = near[np.arange(len(home)), home][:, None] - near
        # How far the homes of these rows are from all centroids, not all centroids from each other.
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (centers[home] @ centers.T)))
        possible = gap <= reach * far + 1e-9
        if replicas is not None and replicas + 1 < len(centers):
            possible &= gap <= np.partition(gap, replicas, axis=1)[:, replicas, None]
        row, cell = np.nonzero(possible)
        homes.append(home)
        rows.append(row + done)
        goes.append(cell)
        done += len(part)
    whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (homes, rows, goes)]
    return whole[0], whole[1], whole[2]


def spherical_kmeans(points: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centroids. Starts from distinct points; a cell that loses all points keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centroids.T).argmax(1) for part in slices(points, len(centroids))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centroids)
    return centroids


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _links(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each left row and each right row have a cosine of at least threshold.
    Products close to it are computed again one by one, alike in every block."""
    left, right = scaled(left), scaled(right)
    a, b = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    cosine = (left / a[:, None]) @ (right / b[:, None]).T
    found = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12)):
        found[i, j] = float((left[i] * right[j]).sum()) / (a[i] * b[j]) >= threshold
    return found


def _goes_to(cells: pa.ChunkedArray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether the rows at some places go to the given cells."""
    cells = cells.combine_chunks()
    size = cells.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(size)), size)
    key = (owner.astype(np.int64) << 32) | cells.flatten().to_numpy()
    return np.isin((row.astype(np.int64) << 32) | cell, key)


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        vectors = _matrix(group["vector"], group["dims"][0].as_py())
        cell, part, home = group["cell"][0].as_py(), group["part"].to_numpy(), group["home"].to_numpy()
        left, right = np.flatnonzero(part == group["l"][0].as_py()), np.flatnonzero(part == group["r"][0].as_py())
        found = _links(vectors[left], vectors[right], threshold) & (ids[left][:, None] != ids[right])
        found &= (home[left] == cell)[:, None] | (home[right] == cell)
        if len(left) and len(right) and left[0] == right[0]:
            found = np.triu(found)  # a part against itself: each pair once
        # Of a pair with two homes, the larger one passes over what the smaller one judges.
        x, y = np.nonzero(found)
        mine, other = left[x], right[y]
        swap = home[mine] != cell
        mine, other = np.where(swap, other, mine), np.where(swap, mine, other)
        again = (home[other] < cell) & (home[other] != cell)
        again[again] = _goes_to(group["cells"], mine[again], home[other][again])
        found[x[again], y[again]] = False
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, left, found @ copies[right])
        np.add.at(links, right, found.T @ copies[left])
        # The smallest id that links lead to within the block.
        root = ids.copy()
        rows = np.flatnonzero(found.any(1))
        columns = np.flatnonzero(found.any(0))
        inner = found[np.ix_(rows, columns)]
        a, b = left[rows], right[columns]
        largest = np.iinfo(np.int64).max
        while len(rows):
            before = root.copy()
            root[a] = np.minimum(root[a], np.where(inner, root[b], largest).min(1))
            root[b] = np.minimum(root[b], np.where(inner, root[a][:, None], largest).min(0))
            if (before == root).all():
                break
        keep = np.union1d(a, b)
        return pa.table({"id": ids[keep], "links": links[keep], "root": root[keep]})

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", replicas: int | None = REPLICAS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of df. replicas=None loses no link."""
    spark = prepare(df.sparkSession)
    with scratch(spark) as keep:
        return keep(materialize(_grouped(df, threshold, vec_id, vector, label, replicas), "near"))


def _grouped(df: DataFrame, threshold: float, vec_id: str, vector: str, label: str, replicas: int | None) -> DataFrame:
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    fit = F.col("label").isNotNull() & F.col("id").isNotNull() & usable("vector")
    live = rows.where(fit).where(F.exists("vector", lambda x: x != 0))
    classes = materialize(live.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("dims", F.size("vector")), "classes")
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    cells = cell_count(most or 0)
    centroids: dict[int, np.ndarray] = {}
    if cells > 1:
        share = min(1.0, max(FIT_ROWS, 4 * cells) / total)
        picked = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("dims", "vector").limit(2 * max(FIT_ROWS, 4 * cells)).toPandas()
        for dims, some in picked.groupby("dims"):
            centroids[int(dims)] = apart(spherical_kmeans(unit(np.array(some["vector"].tolist(), np.float64)), cells), threshold)
    shared = spark.sparkContext.broadcast(centroids)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def assign(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims_of = table["dims"].to_numpy()
            for dims in np.unique(dims_of):
                some = table.take(pa.array(np.flatnonzero(dims_of == dims)))
                centers = shared.value.get(int(dims))
                if centers is None:
                    home, offsets, goes = np.zeros(len(some), np.int32), np.arange(len(some) + 1), np.zeros(len(some), np.int32)
                else:
                    home, row, goes = cells_of(unit(_matrix(some["vector"], int(dims))), centers, reach, replicas)
                    offsets = np.searchsorted(row, np.arange(len(some) + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(goes, pa.int32()))
                yield from some.append_column("home", pa.array(home, pa.int32())).append_column("cells", lists).combine_chunks().to_batches()

    schema = T.StructType(classes.schema.fields + [T.StructField("home", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    placed = classes.mapInArrow(assign, schema).withColumn("cell", F.explode("cells"))
    keys = ["label", "dims", "cell"]
    count = placed.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = placed.join(count, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = placed.withColumn("other", other).select(*keys, "id", "copies", "vector", "home", "cells", "part", F.least("part", "other").alias("l"), F.greatest("part", "other").alias("r"))
    found = materialize(dealt.groupBy(*keys, "l", "r").applyInArrow(_compare(threshold), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("id <> root").select("id", "root"), "id", "root")
    groups = classes.join(links, "id", "left").join(component.select(F.col("node").alias("id"), "component"), "id", "left")
    groups = groups.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(groups, ["label", "vector"], "left")
    component_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("id") == component_id).alias("kept"))
