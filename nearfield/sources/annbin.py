"""Benchmark data sets: a binary file of training vectors, test vectors and true neighbours, and generators.

File: a header of 40 bytes (magic ANNB, then nine little-endian 32-bit numbers: version, training rows, test
rows, dimensions, neighbours a test row, metric, three reserved), 32-bit floats of
the training and the test rows, and 32-bit neighbour numbers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.plans.config import METRICS, CorruptFile

MAGIC = b"ANNB"
HEADER = struct.Struct("<4s9I")


def save(path: str, train: np.ndarray, test: np.ndarray, truth: np.ndarray, metric: str = "cosine") -> None:
    with open(path, "wb") as f:
        f.write(HEADER.pack(MAGIC, 1, len(train), len(test), train.shape[1], truth.shape[1], METRICS.index(metric), 0, 0, 0))
        for part, kind in ((train, "<f4"), (test, "<f4"), (truth, "<u4")):
            f.write(np.ascontiguousarray(part, kind).tobytes())


def parse(raw: bytes) -> dict:
    if len(raw) < HEADER.size:
        raise CorruptFile("shorter than its header")
    magic, version, n, m, dims, k, metric, *_ = HEADER.unpack_from(raw)
    if magic != MAGIC or version != 1 or metric >= len(METRICS):
        raise CorruptFile("no data set, or of an unknown version")
    if len(raw) != HEADER.size + 4 * (n * dims + m * dims + m * k):
        raise CorruptFile("its length is not the one of its header")
    at = HEADER.size
    train = np.frombuffer(raw, "<f4", n * dims, at).reshape(n, dims)
    test = np.frombuffer(raw, "<f4", m * dims, at + 4 * n * dims).reshape(m, dims)
    truth = np.frombuffer(raw, "<u4", m * k, at + 4 * (n + m) * dims).reshape(m, k)
    return {"train": train, "test": test, "truth": truth, "metric": METRICS[metric]}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """DataFrames train (id, vector), test (id, vector) and truth (query_id, rank, id), read where the file is, by Spark."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def vectors(part: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    rows = parse(content.as_py())[part]
                    for i in range(0, len(rows), 4096):
                        some = rows[i : i + 4096]
                        values = pa.array(list(some), pa.list_(pa.float32()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(some)), pa.int64()), values], ["id", "vector"])

        return files.mapInArrow(run, "id long, vector array<float>")

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = parse(content.as_py())["truth"]
                m, k = rows.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(m), k), pa.int64()), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(rows.ravel().astype(np.int64))], ["query_id", "rank", "id"])

    return {"train": vectors("train"), "test": vectors("test"), "truth": files.mapInArrow(truth, "query_id long, rank int, id long")}


def from_hdf5(source: str, target: str) -> None:
    """Converts a file of the public ANN benchmarks (train, test, neighbors); needs h5py. The file's name tells the metric."""
    import h5py

    metric = "l2" if "euclidean" in source else "inner_product" if "dot" in source else "hamming" if "hamming" in source else "cosine"
    with h5py.File(source) as f:
        save(target, f["train"][:], f["test"][:], f["neighbors"][:], metric)


def sinusoid(spark: SparkSession, rows: int, dims: int, seed: int = 0, a: float = 0.173, b: float = 0.071) -> DataFrame:
    """Rows (id, vector) with components sin(i * a) + cos(i * b), i = (row + seed) * dims + column."""
    i = lambda j: ((F.col("id") + seed) * dims + j).cast("double")
    return spark.range(rows).withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: (F.sin(i(j) * a) + F.cos(i(j) * b)).cast("float")))


def clustered(spark: SparkSession, rows: int, dims: int, centers: int, noise: float = 0.02, seed: int = 7) -> DataFrame:
    """Rows (id, vector): row i lies around centre i modulo centers, all from hashes, so reruns agree."""
    unit = lambda *key: F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 29) - 1
    center = F.col("id") % centers
    return spark.range(rows).withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: (unit(center, j, F.lit(seed)) + noise * unit(F.col("id"), j, F.lit(seed + 1))).cast("float")))
