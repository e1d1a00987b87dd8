"""Statuses of positions: what supply covers a group of tagged demand, and texts derived from one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(demand: DataFrame, supply: DataFrame, keys: list[str], tags: str, quantity: str) -> DataFrame:
    """(keys, needed, tagged, untagged, status) of each group of tagged, unmatched demand. ``tagged`` sums supply that shares
    a tag with the group, each row once; ``untagged`` sums supply without tags. Less than needed in all: ``excluded``; less
    by tags, with some untagged: ``untagged``; else blank."""
    needed = demand.filter(F.size(tags) > 0).groupBy(*keys).agg(F.sum(quantity).alias("needed"))
    wanted = demand.select(*keys, F.explode(tags).alias("tag")).distinct()
    hits = supply.select(*keys, "supply_id", quantity, F.explode(F.array_distinct(tags)).alias("tag")).join(wanted, [*keys, "tag"]).select(*keys, "supply_id", quantity).distinct()
    tagged = hits.groupBy(*keys).agg(F.sum(quantity).alias("tagged"))
    untagged = supply.filter(F.size(tags) == 0).groupBy(*keys).agg(F.sum(quantity).alias("untagged"))
    out = needed.join(tagged, keys, "left").join(untagged, keys, "left").fillna(0, ["tagged", "untagged"])
    status = F.when(F.col("tagged") + F.col("untagged") < F.col("needed"), "excluded").when((F.col("tagged") < F.col("needed")) & (F.col("untagged") > 0), "untagged").otherwise("")
    return out.withColumn("status", status)


def effective_tag(vendor_tag: Column, supply_tag: Column, tags: Column, has_code: Column, excluded: Column) -> Column:
    """The vendor's tag before the supply's before the first of the demand's; that one only with a counterpart's code, or
    where the row is excluded from supply on purpose."""
    first = F.get(tags, F.lit(0))
    return F.coalesce(F.when(vendor_tag != "", vendor_tag), F.when(supply_tag != "", supply_tag), F.when(has_code | excluded, first), F.lit(""))


def pair_status(left: Column, right: Column, agree: Column) -> Column:
    """``equal`` or ``different`` where both are there, else which one is, else ``none``. Blank counts as missing."""
    has_left, has_right = F.coalesce(left != "", F.lit(False)), F.coalesce(right != "", F.lit(False))
    return F.when(has_left & has_right, F.when(agree, "equal").otherwise("different")).when(has_left, "left only").when(has_right, "right only").otherwise("none")


def struck_status(code: Column, struck: Column) -> Column:
    """Whether a struck code is the row's own; blank unless both are there."""
    both = (F.coalesce(code, F.lit("")) != "") & (F.coalesce(struck, F.lit("")) != "")
    return F.when(both, F.when(F.upper(F.trim(code)) == F.upper(F.trim(struck)), "same").otherwise("other")).otherwise("")


def merged_places(current: Column, new: Column) -> Column:
    """Places joined by slashes, each once."""
    parts = F.filter(F.transform(F.split(F.concat_ws("/", current, new), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(parts), "/")


def units_agree(*units: Column) -> Column:
    """Two or more units that are there, all the same; null if fewer than two are."""
    there = F.filter(F.array(*units), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(there) >= 2, F.size(F.array_distinct(there)) == 1)


def same_unit_difference(left: Column, right: Column, left_unit: Column, right_unit: Column) -> Column:
    """right - left where both have one and the same unit, else null."""
    return F.when((left_unit != "") & (left_unit == right_unit), right - left)


def difference_status(diff: Column, eps: float = 1e-9) -> Column:
    return F.when(F.abs(diff) < eps, "match").when(diff < 0, "increase").otherwise("shortfall")


def delivery_status(ordered: Column, delivered: Column, demand: Column, supply: Column, vendor: Column, unit_problem: Column) -> Column:
    """Delivered against ordered; without any delivery, what sources know the position; a unit clash comes first."""
    presence = F.when(demand & supply, "open").when(demand, "demand only").when(supply, "supply only").when(vendor, "vendor only").otherwise("demand only")
    return F.when(unit_problem, "data problem").when(F.coalesce(delivered, F.lit(0)) == 0, presence).when(~demand, "delivery only").when(delivered < ordered, "short").when(delivered > ordered, "over").otherwise("complete")
