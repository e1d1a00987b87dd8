"""Readers. A table is one Parquet file or folder below a root; text tables with a positional column map come from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def positional(spark: SparkSession, path: str, columns: dict[int, str], separator: str = ";", skip_empty: bool = True) -> DataFrame:
    """A delimited text table whose columns are known by position; blanks become null and the source is kept."""
    width = max(columns) + 1
    raw = spark.read.csv(path, sep=separator, schema=", ".join(f"_c{i} string" for i in range(width)), mode="PERMISSIVE")
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = raw.select(*[blank(F.col(f"_c{i}")).alias(n) for i, n in sorted(columns.items())], F.col("_metadata.file_path").alias("source_file"))
    return out.filter(" or ".join(f"`{n}` is not null" for n in columns.values())) if skip_empty else out
