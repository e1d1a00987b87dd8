"""Grouped reconciliation of two sides, presence matrices, conservation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_sides(left: DataFrame, right: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    """Sums of both sides by key and their difference, as one aggregation of a tagged union instead of a full outer join."""
    both = left.select(*keys, F.col(quantity).alias("l"), F.lit(None).cast("long").alias("r")).unionAll(right.select(*keys, F.lit(None).cast("long").alias("l"), F.col(quantity).alias("r")))
    out = both.groupBy(*keys).agg(F.sum("l").alias("left_qty"), F.sum("r").alias("right_qty"))
    status = F.when(F.col("left_qty").isNull(), "right only").when(F.col("right_qty").isNull(), "left only").when(F.col("left_qty") == F.col("right_qty"), "equal").when(F.col("left_qty") < F.col("right_qty"), "over").otherwise("short")
    return out.withColumn("diff", F.coalesce("left_qty", F.lit(0)) - F.coalesce("right_qty", F.lit(0))).withColumn("status", status)


def presence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """One row for each key that any source has, with a flag for each source."""
    tagged = [df.select(F.col(key).cast("long").alias(key), *[F.lit(name == own).alias(f"in_{own}") for own in sources]) for name, df in sources.items()]
    return reduce(DataFrame.unionAll, tagged).groupBy(key).agg(*[F.bool_or(f"in_{own}").alias(f"in_{own}") for own in sources])


def verdict(delta: Column, tolerance: Column) -> Column:
    """Tiers of a conservation check."""
    return F.when(F.abs(delta) <= F.lit(0.01), "ok").when(F.abs(delta) <= tolerance, "warn").otherwise("error")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
