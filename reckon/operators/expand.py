"""Rows to units and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def demand_units(df: DataFrame, quantity: str, tags: str, unit_banned: Column, code_banned: Column | None = None) -> DataFrame:
    """Explode demand with a whole quantity: several tags make a row each (the first ``quantity`` of them count 1, later ones
    0), unless the unit is banned; without tags a quantity over 1 makes single units, unless unit or code is banned. Anything
    else passes unchanged."""
    code_banned = F.lit(False) if code_banned is None else code_banned
    whole = (F.col(quantity) >= 0) & (F.col(quantity) == F.floor(quantity))
    by_tag = F.transform(F.col(tags), lambda t, i: F.struct(t.alias("tag"), F.when(i < F.col(quantity), 1).otherwise(0).cast("double").alias("qty")))
    by_unit = F.transform(F.sequence(F.lit(1), F.greatest(F.col(quantity).cast("int"), F.lit(1))), lambda _: F.struct(F.lit(None).cast("string").alias("tag"), F.lit(1.0).alias("qty")))
    same = F.array(F.struct(F.get(F.col(tags), F.lit(0)).alias("tag"), F.col(quantity).cast("double").alias("qty")))
    units = F.when(whole & ~unit_banned & (F.size(tags) > 1), by_tag).when(whole & ~unit_banned & ~code_banned & (F.size(tags) == 0) & (F.col(quantity) > 1), by_unit).otherwise(same)
    return df.withColumn("__u", F.explode(units)).withColumns({"unit_tag": F.col("__u.tag"), "unit_qty": F.col("__u.qty")}).drop("__u")


def fill_forward(df: DataFrame, keys: list[str], order: list, heading: Column, name: str) -> DataFrame:
    """Each row gets the last heading at or before it."""
    return df.withColumn(name, F.last(heading, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
