"""Reports of measurements as CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
