"""Versioned snapshots: Parquet side tables and manifests that are written last.

A snapshot is a folder of versions and of numbered manifests. A manifest is written beside its place and renamed into it,
never over another one; the newest one counts, so readers see a version whole or not at all and
a writer that dies leaves the version before. Files go through Hadoop's file systems, so any path that Spark reads will do.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.plans.config import CorruptFile

FORMAT = 1


class Conflict(CorruptFile):
    """Another writer's manifest took the place meanwhile."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside its place, then renamed into it. A file that is there already is an error."""
    fs, target = _fs(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise Conflict(f"{path} is there already, or could not be written")


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise CorruptFile(f"{path} is missing")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except (TypeError, ValueError) as error:
        raise CorruptFile(f"{path} is no JSON") from error
    finally:
        stream.close()


def manifests(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests of a folder, in order."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in names) if m)


def newest(spark: SparkSession, path: str) -> dict:
    """The newest manifest."""
    found = manifests(spark, path)
    if not found:
        raise CorruptFile(f"{path} has no manifest")
    return read_json(spark, f"{path}/manifest-{found[-1]}.json")


def commit(spark: SparkSession, path: str, value: dict, after: int | None = None) -> int:
    """Makes value the newest manifest; returns its number. after: the manifest that value was made from; where there is a newer one, or
    two writers are at it at once, the later one gets a Conflict and may try again from the newest."""
    last = (manifests(spark, path) or [0])[-1]
    if after is not None and last != after:
        raise Conflict(f"{path} has gone on to manifest {last}")
    write_json(spark, f"{path}/manifest-{last + 1}.json", value | {"format": FORMAT, "version": last + 1, "written": time.time()})
    return last + 1


def named(value) -> set[str]:
    """All texts in a manifest; folders are among them."""
    if isinstance(value, dict):
        return set().union(*(named(v) for v in value.values()))
    if isinstance(value, (list, tuple)):
        return set().union(*(named(v) for v in value))
    return {value} if isinstance(value, str) else set()


def forget(spark: SparkSession, path: str, keep: int) -> int:
    """Deletes the manifests but the newest `keep`, and the folders that only deleted ones name; returns how many folders. What no
    manifest names yet may be another writer's work and stays."""
    numbers = manifests(spark, path)
    old, kept = numbers[:-keep], numbers[-keep:]
    if not old:
        return 0
    fs, p = _fs(spark, path)
    once = set().union(*(named(read_json(spark, f"{path}/manifest-{n}.json")) for n in old))
    once -= set().union(*(named(read_json(spark, f"{path}/manifest-{n}.json")) for n in kept))
    for number in old:
        fs.delete(_fs(spark, f"{path}/manifest-{number}.json")[1], False)
    folders = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() in once]
    for folder in folders:
        fs.delete(folder, True)
    return len(folders)


def _counted(df: DataFrame):
    """(rows, a sum over all ids that does not depend on their order): equal for equal sets of ids."""
    mark = F.sum(F.xxhash64("id").cast("decimal(38,0)")) if "id" in df.columns else F.lit(0)
    rows, ids = df.agg(F.count("*"), mark).first()
    return rows, str(ids or 0)


def unmatched(tables: dict[str, DataFrame], main: str = "vectors") -> DataFrame | None:
    """Rows (table, id, problem): ids of side tables that the main table has not, and ids that it has twice. None without a main
    table of ids."""
    if main not in tables or "id" not in tables[main].columns:
        return None
    ids = tables[main].select("id")
    out = ids.groupBy("id").count().where("count > 1").select(F.lit(main).alias("table"), "id", F.lit("twice").alias("problem"))
    for name, df in tables.items():
        if name != main and "id" in df.columns:
            lost = df.select("id").join(ids, "id", "left_anti").distinct()
            out = out.unionByName(lost.select(F.lit(name).alias("table"), "id", F.lit("unknown").alias("problem")))
    return out


def save(path: str, tables: dict[str, DataFrame], config: dict) -> int:
    """Writes a new version of all tables, then the manifest that names it."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    counts, ids = {}, {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
        counts[name], ids[name] = _counted(spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}"))
    return commit(spark, path, {"folder": folder, "tables": counts, "ids": ids, "config": config})


def load(spark: SparkSession, path: str, mode: str = "lazy") -> tuple[dict[str, DataFrame], dict]:
    """The current version's tables and configuration. mode: memory, disk (both cached) or lazy (read as needed). A table whose rows or
    ids are not those of the manifest, and side tables with ids that the vectors have not, are refused."""
    manifest = newest(spark, path)
    if manifest.get("format") != FORMAT:
        raise CorruptFile(f"unknown format {manifest.get('format')}")
    tables = {}
    for name, count in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{manifest['folder']}/{name}")
        rows, ids = _counted(df)
        if rows != count:
            raise CorruptFile(f"{name} has not the {count} rows of the manifest")
        if manifest.get("ids", {}).get(name, ids) != ids:
            raise CorruptFile(f"{name} has other ids than those of the manifest")
        if mode != "lazy":
            df = df.persist(StorageLevel.MEMORY_ONLY if mode == "memory" else StorageLevel.DISK_ONLY)
        tables[name] = df
    wrong = unmatched(tables)
    first = wrong.limit(3).collect() if wrong is not None else []
    if first:
        raise CorruptFile("ids do not match: " + ", ".join(f"{r['table']} {r['id']} {r['problem']}" for r in first))
    return tables, manifest["config"]


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the manifests but the newest, and every folder that it does not name, also those of writers that died (or are still
    at work); returns how many folders."""
    current = named(newest(spark, path))
    fs, p = _fs(spark, path)
    for number in manifests(spark, path)[:-1]:
        fs.delete(_fs(spark, f"{path}/manifest-{number}.json")[1], False)
    old = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in current]
    for folder in old:
        fs.delete(folder, True)
    return len(old)
