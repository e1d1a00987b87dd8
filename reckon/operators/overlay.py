"""Newest-wins versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_wins(df: DataFrame, keys: list[str], order: list[Column], ignored: Column | None = None) -> DataFrame:
    """Adds ``status``: the first selectable row by ``order`` is current, the others are superseded or ignored."""
    skip = ignored if ignored is not None else F.lit(False)
    place = F.row_number().over(W.partitionBy(*keys, skip).orderBy(*order))
    return df.withColumn("status", F.when(skip, "ignored").when(place == 1, "current").otherwise("superseded"))


def latest(df: DataFrame, keys: list[str], by: list[str], take: list[str]) -> DataFrame:
    """The newest row of each key through an aggregate: combined before the exchange, unlike a window."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*by, *[c for c in take if c not in by])).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in [*by, *[c for c in take if c not in by]]])


def order_conflicts(df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """Rows whose value is lower than one that came before them within the key (a running maximum, not a self-join)."""
    before = F.max(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("highest_before", before).filter(value < F.col("highest_before"))


def overlay(df: DataFrame, keys: list[str], sequence: str, rank: Column, time: str, path: str, ignored: Column) -> DataFrame:
    """Adds ``status`` and ``conflict``. The newest transfer is current even if its revision is lower, which is a conflict.
    Of files with the newest transfer and revision the latest is current, the others are ambiguous; older ones are
    superseded; ignored ones are listed but never chosen, nor do they make a conflict."""
    ranked = df.withColumn("__skip", ignored).withColumn("__rank", rank)
    w = W.partitionBy(*keys, "__skip").orderBy(F.desc(sequence), F.desc("__rank"), F.desc(time), F.desc(path))
    top = F.first(F.struct(sequence, "__rank")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    highest = F.max("__rank").over(W.partitionBy(*keys, "__skip"))
    x = ranked.withColumns({"__place": F.row_number().over(w), "__top": top, "__highest": highest})
    tie = (F.col(sequence) == F.col(f"__top.{sequence}")) & (F.col("__rank") == F.col("__top.__rank"))
    status = F.when(F.col("__skip"), "ignored").when(F.col("__place") == 1, "current").when(tie, "ambiguous").otherwise("superseded")
    return x.withColumns({"status": status, "conflict": ~F.col("__skip") & (F.col("__place") == 1) & (F.col("__rank") < F.col("__highest"))}).drop("__skip", "__rank", "__place", "__top", "__highest")
