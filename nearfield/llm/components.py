"""Connected components by alternating large-star and small-star.

Large-star joins every larger neighbour of a node to the smallest node of its
neighbourhood, small-star every smaller one; both keep components and shorten
them to stars in a logarithmic number of rounds. All steps are joins and
aggregations of edge rows; each round is written to the shared folder, which
cuts the lineage, in as few files as its edges fill: no round has more than the one before. Hot nodes: minima are aggregated before the shuffle and the
joins are ones that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nearfield.runtime import discard, few, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> Row:
    """Both stars lower sums of the ends; the same rows twice mean that only stars are left."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, u: str = "src", v: str = "dst", rows: int | None = None) -> DataFrame:
    """Rows (node, component) for every node of an edge; component is its smallest reachable node.
    rows: how many edges there are at most, if that is known.

    Edges with a null end and loops are passed over, repeated edges count once;
    no edges give no rows. Nodes without edges do not appear.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now if rows is None else few(now, rows), "edges")
    mark = _mark(now)
    while mark[0]:
        new = materialize(few(_small_star(_large_star(now)), mark[0]), "edges")
        discard(now)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
