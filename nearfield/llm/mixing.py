"""Mixing sources to target weights by weighted fair queueing.

Every document may be taken up to PASSES times. In each source the documents
stand in a shuffled order (by a hash of their id); a copy's virtual finish time
is the number of words that its source has handed out up to its end, divided by
the source's weight. All copies are range-sorted by finish time and taken until
the words of the budget are used up. A source that has handed out all its
copies is out of the queue, and so the others share the rest by weight.

Edge cases: a null text has no words; a null source is a source of its own,
last in order; documents without words are taken with 0 words; ties
are ordered by source, hash, id and row; rows that share an id count one by one;
an empty table gives no rows. A document is taken whole or not at all, so a source
ends within one document of its target, and the mix within one of its budget. Other
columns come along only in the struct `carried`, so their names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.ordered import running_sums
from nearfield.runtime import materialize, prepare, scratch

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 2


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], percent: int) -> DataFrame:
    """sizes: (source, source_size). Adds start (words of the sources before it), place, weight and target."""
    by_name = [F.col("source").isNull().cast("int"), F.col("source")]
    placed = running_sums(sizes.withColumn("_one", F.lit(1).cast("long")), by_name, {"_end": "source_size", "_place": "_one"}, "sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = placed.withColumns({"weight": weight, "start": F.col("_end") - F.col("source_size"), "place": F.col("_place"), "most": PASSES * F.col("source_size")})
    full_at = F.col("most") / F.col("weight")  # the virtual time at which the source has handed out all
    filled = running_sums(placed.drop("_end", "_place", "_one"), [full_at, F.col("place")], {"_full": "most", "_weight": "weight"}, "filled")
    total, weight_sum = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (total or 0) * percent / 100
    level = F.col("_full") + full_at * (F.lit(weight_sum or 0) - F.col("_weight"))
    first = filled.where(level >= budget).orderBy(full_at, "place").select((F.lit(budget) - (F.col("_full") - F.col("most"))).alias("words"), (F.lit(weight_sum or 0) - (F.col("_weight") - F.col("weight"))).alias("weight")).first()
    until = first["words"] / first["weight"] if first else 0.0
    return filled.withColumn("target", F.least(F.col("most").cast("double"), F.lit(until) * F.col("weight"))).drop("_full", "_weight", "most")


def mix(docs: DataFrame, weights: list[int], percent: int, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for each row of docs, and, if columns are named in carry,
    the struct `carried` of them. weights repeat over the sources in code point order; the mix
    has percent/100 of all words. taken: the document's words that the mix takes, repeats counted."""
    spark = prepare(docs.sparkSession)
    with scratch(spark) as keep:
        return keep(materialize(_mixed(docs, weights, percent, doc_id, text, source, carry or []), "mixed"))


def _mixed(docs: DataFrame, weights: list[int], percent: int, doc_id: str, text: str, source: str, carry: list[str]) -> DataFrame:
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.col(text).alias("_text"), *carried)
    base = materialize(base.withColumns({"row": F.monotonically_increasing_id(), "hash": F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.hex(F.xxhash64("_text")))}).drop("_text"), "sizes")
    sizes = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent)
    sizes = materialize(sizes, "targets")
    order = [F.col("source").isNull().cast("int"), F.col("source"), F.col("hash"), F.col("row")]
    queued = running_sums(base.select("row", "doc_id", "source", "size", "hash"), order, {"end": "size"}, "queued")
    queued = queued.join(sizes.withColumnRenamed("source", "_source"), F.expr("source <=> _source")).drop("_source")
    finish = lambda copy: (F.col("end") - F.col("start") + copy * F.col("source_size")) / F.col("weight")
    key = lambda copy, time: F.struct(time.alias("finish"), F.col("place"), F.col("hash"), F.col("row"), copy.alias("copy"))
    copies = queued.where("size > 0").select("size", "place", "hash", "row", "start", "end", "source_size", "weight", F.explode(F.array(*[F.lit(i) for i in range(PASSES)])).alias("copy"))
    copies = copies.select("size", key(F.col("copy"), finish(F.col("copy"))).alias("key"))
    sorted_copies = running_sums(copies, [F.col("key")], {"taken": "size"}, "copies")
    budget = (base.agg(F.sum("size")).first()[0] or 0) * percent / 100
    last = sorted_copies.where(F.col("taken") <= budget).agg(F.max("key").alias("key")).first()["key"]
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["place"]).alias("place"), F.lit(last["hash"]).alias("hash"), F.lit(last["row"]).alias("row"), F.lit(last["copy"]).alias("copy"))
        taken = sum((F.when(key(F.lit(i), finish(F.lit(i))) <= end, F.col("size")).otherwise(0) for i in range(PASSES)), F.lit(0)).cast("long")
    out = queued.select("row", "doc_id", "size", "source_size", "target", taken.alias("taken"))
    if carry:
        out = out.join(base.select("row", "carried"), "row")
    return out.drop("row")
