"""Session helpers shared by every subpackage: shared work folders, lineage cuts, worker imports."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_local_dir: str | None = None
#: Python workers live long and share an executor's memory, so they give back what large arrays used.
MALLOC = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver found it, and keep Arrow batches of long rows small."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    for name, value in MALLOC.items():
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("67108864b", "64m"):  # its default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", "4096") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")
    return spark


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that does the same, and at a task's end returns what the worker has freed to the
    system: small arrays between others stay mapped otherwise, while the next stage's needs come on top."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim is not None:
            trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local[...] master may go without one: driver and executors are then
    one process, and a temporary folder serves.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_dir is None:
        folder = tempfile.mkdtemp(prefix="nearfield-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_dir = "file://" + folder
    return _local_dir


_scopes = threading.local()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the innermost scratch() of this thread deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes on leaving all work files that this thread made inside, but for those of the
    materialize() results given to the function it yields; they are the scope's around it, or the caller's."""
    stack = _scopes.__dict__.setdefault("stack", [])
    paths: list[str] = []
    kept: list[str] = []
    stack.append(paths)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._nearfield_path)
        return df

    try:
        yield keep
    finally:
        stack.pop()
        if stack:
            stack[-1].extend(kept)
        remove(spark, [p for p in paths if p not in kept])


#: With it Spark deletes shuffle files as soon as the query is over that made them; without, when the driver collects its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go with each query. For steps that are written and read back: what is
    run a second time shuffles anew."""
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Small row groups, looked at often: rows of intermediate tables may be long, and readers and
#: writers hold a row group in memory.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4"}


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts the
    lineage and survives lost executors, for the files belong to no executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(compression=compression, **ROW_GROUPS).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nearfield_path = path
    return out


#: Rows of ids that one file holds at least, if there are so many.
FILE_ROWS = 1 << 16


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df, of at most so many rows, in no more partitions than `each` rows a partition take. Hadoop's local file system
    starts processes for each file it makes, and while one starts it may be counted as a second copy of its executor."""
    return df.coalesce(max(1, -(-rows // each)))


def discard(df: DataFrame) -> None:
    """Delete the files of a materialize() result that nothing reads any more."""
    path = getattr(df, "_nearfield_path", None)
    if path:
        remove(df.sparkSession, [path])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
