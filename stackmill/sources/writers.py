"""Sinks. All take a folder that every executor can reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.sources.readers import normalize_record

TASKS_A_FILE, ROWS_A_FILE = 16, 1_000_000


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("model", "role")) -> str:
    """One folder per model and role, so that a reader of one role lists and scans only that folder.

    The rows of a folder are gathered from ``TASKS_A_FILE`` tasks and ``ROWS_A_FILE`` rows of each at a time: one file per
    folder and that many rows, while a folder with a third of all rows is still written by many tasks.
    """
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the number of a row inside its task
    part = F.struct(F.floor(F.spark_partition_id() / TASKS_A_FILE), F.floor(row / ROWS_A_FILE))
    spread = df.withColumn("__part", part)
    spread.repartition(*by, "__part").drop("__part").write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_records(df: DataFrame, path: str, record: str = "record") -> str:
    """Normalised molecule records as text with the record separator."""
    normal = df.select(normalize_record(F.col(record)).alias("value"))
    normal.write.mode("overwrite").option("lineSep", "$$$$\n").text(path)
    return path
