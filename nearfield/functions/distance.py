"""Distances and encodings of vectors as Spark expressions. Smaller is nearer for every metric."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TINY = 1e-10


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm_sq(a: Column | str) -> Column:
    return _sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, a_norm_sq: Column | None = None, b_norm_sq: Column | None = None) -> Column:
    """1 - cos, and 1 where the product of the norms is below 1e-10."""
    size = F.sqrt(norm_sq(a) if a_norm_sq is None else a_norm_sq) * F.sqrt(norm_sq(b) if b_norm_sq is None else b_norm_sq)
    return F.when(size < TINY, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - dot(a, b) / size))


def l2(a: Column | str, b: Column | str) -> Column:
    """The squared Euclidean distance."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def hamming(a: Column | str, b: Column | str) -> Column:
    """The number of places that differ."""
    return F.size(F.filter(F.zip_with(_col(a), _col(b), lambda x, y: x != y), lambda d: d)).cast("double")


def binarize(a: Column | str) -> Column:
    return F.transform(_col(a), lambda x: (x >= 0).cast("int"))


def pack_bits(bits: Column | str) -> Column:
    """Bits as 64-bit words, the first bit highest; the last word is filled with zeros."""
    bits = _col(bits)
    words = F.sequence(F.lit(0), F.ceil(F.size(bits) / 64).cast("int") - 1)
    word = lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("long")))
    # The last word moves up by the bits that it lacks.
    lack = lambda w: F.greatest(F.lit(0), (w + 1) * 64 - F.size(bits))
    return F.when(F.size(bits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(words, lambda w: F.call_function("shiftleft", word(w), lack(w))))


def unpack_bits(words: Column | str, dims: int) -> Column:
    """The first dims bits of packed words."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.call_function("shiftrightunsigned", F.element_at(_col(words), (i / 64).cast("int") + 1), F.lit(63) - i % 64).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def hamming_words(a: Column | str, b: Column | str) -> Column:
    """Hamming distance of packed words."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """hamming compares the signs of the components."""
    if metric == "hamming":
        return hamming(binarize(a), binarize(b))
    return {"cosine": cosine, "l2": l2, "inner_product": inner_product}[metric](a, b)


def normalized(a: Column | str) -> Column:
    size = F.sqrt(norm_sq(a))
    return F.when(size < TINY, _col(a).cast("array<double>")).otherwise(F.transform(_col(a), lambda x: x.cast("double") / size))


def residual(a: Column | str, center: Column | str) -> Column:
    return F.zip_with(_col(a), _col(center), lambda x, y: x.cast("double") - y.cast("double"))


def int8_scale(a: Column | str) -> Column:
    """The step of the symmetric 8-bit code: largest magnitude / 127, or 1 for a zero vector."""
    top = F.coalesce(F.array_max(F.transform(_col(a), lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 127.0)


def int8_codes(a: Column | str) -> Column:
    """Codes from -127 to 127, halves rounded away from zero."""
    step = int8_scale(a)
    return F.transform(_col(a), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / step).cast("int"))))


def pq_reconstruct(codes: Column | str, codebooks: Column | str) -> Column:
    """The vector that codes stand for; codebooks: subspace -> code -> part."""
    return F.flatten(F.transform(_col(codes), lambda c, m: F.element_at(F.element_at(_col(codebooks), m + 1), c.cast("int") + 1)))


def adc(codes: Column | str, tables: Column | str) -> Column:
    """The sum of a query's table entries for each subspace's code."""
    return _sum(F.transform(_col(codes), lambda c, m: F.element_at(F.element_at(_col(tables), m + 1), c.cast("int") + 1)))


def parse_id(text: Column | str) -> Column:
    """'123' and 'v_123' both give 123; what follows the first underscore must be a number, else null."""
    text = _col(text)
    tail = F.when(F.contains(text, F.lit("_")), F.regexp_extract(text, r"^[^_]*_(.*)$", 1)).otherwise(text)
    return F.when(tail.rlike(r"^[0-9]+$"), tail.try_cast("bigint"))


def register(spark: SparkSession) -> None:
    """Makes vec_distance(a, b, metric) known to SQL, as an expression and not as a UDF."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION vec_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, metric STRING) RETURNS DOUBLE RETURN CASE metric
        WHEN 'l2' THEN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)
        WHEN 'inner_product' THEN -aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
        WHEN 'hamming' THEN CAST(size(filter(zip_with(a, b, (x, y) -> (x >= 0) <> (y >= 0)), d -> d)) AS DOUBLE)
        WHEN 'cosine' THEN CASE WHEN sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) < 1e-10 THEN 1D
            ELSE greatest(0D, 1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))) END END"""
    )


def register_table_function(spark: SparkSession, name: str, view: str, id_type: str = "BIGINT") -> None:
    """Makes a SQL table function name(query, k, metric) with rows (rank, id, distance): the k nearest rows of a view
    (id, vector). The rank's limit holds in every task before rows are brought together."""
    register(spark)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, k INT, metric STRING) RETURNS TABLE(rank INT, id {id_type}, distance DOUBLE)
        RETURN SELECT CAST(rank AS INT), id, distance FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank
            FROM (SELECT id, vec_distance(CAST(vector AS ARRAY<DOUBLE>), query, metric) AS distance FROM {view})) WHERE rank <= k"""
    )
