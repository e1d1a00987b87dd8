"""Writers: partitions replaced by key, rows inserted once, snapshots as versions. Each can be repeated without harm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.sources.work import work_folder  # noqa: F401


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Write ``df`` by partition; partitions that it has are replaced whole, all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def insert_once(df: DataFrame, path: str, keys: list[str], first: bool = False) -> int:
    """Append the rows whose key the table doesn't have yet, one for each key; returns how many. ``first``: no table yet."""
    new = df.dropDuplicates(keys)
    if not first:
        new = new.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    batch = f"{path}/batch={uuid.uuid4().hex}"
    new.write.parquet(batch)
    return df.sparkSession.read.parquet(batch).count()


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A snapshot under its own number; a repeated try replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/v={version}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A snapshot by number, else the newest one."""
    found = spark.read.parquet(path)
    version = found.agg(F.max("v")).first()[0] if version is None else version
    return found.filter(F.col("v") == version).drop("v")


def wide(df: DataFrame, keys: list[str], column: str, values: list, measure: str) -> DataFrame:
    """A table with one column for each known value, for a sheet: sums, zero where there is none."""
    return df.groupBy(*keys).pivot(column, values).agg(F.sum(measure)).fillna(0)
