"""Subset sums: the first terms of a group that make up its target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reckon.operators.fold import folded


def first_indices(values: list[int], target: int) -> list[int] | None:
    """Places of the first solution, if an earlier term is taken whenever it can be: None if there is none.

    What the terms from each place on can make is a row of bits, one for each sum up to the target, worked out from the last
    term to the first; the way back then reads one bit a term. Every root-th row is kept and the others are made again block
    by block, so memory is twice the root of the terms by the target in bits, and time is twice terms by target over 64."""
    if target <= 0:
        return [] if target == 0 else None
    n, mask = len(values), (1 << (target + 1)) - 1
    block = max(1, int(n**0.5))
    kept, reach = {n: 1}, 1
    for k in range(n - 1, -1, -1):
        if 0 <= values[k] <= target:
            reach |= (reach << values[k]) & mask
        if k % block == 0:
            kept[k] = reach
    if not reach >> target & 1:
        return None
    found, left = [], target
    for start in range(0, n, block):
        end = min(n, start + block)
        rows = [kept[end]]
        for k in range(end - 1, start, -1):
            v = values[k]
            rows.append(rows[-1] | (rows[-1] << v) & mask if 0 <= v <= target else rows[-1])
        for k in range(start, end):
            if left == 0:
                return found
            v = values[k]
            if 0 <= v <= left and rows[end - 1 - k] >> (left - v) & 1:
                found.append(k)
                left -= v
    return found


class _Terms:
    def __init__(self, width: int):
        self.width, self.values, self.ids, self.key, self.target = width, [], [], None, None

    def __call__(self, row: dict) -> list[tuple]:
        self.key, self.target = tuple(row[f"k{i}"] for i in range(self.width)), row["target"]
        self.values.append(row["value"])
        self.ids.append(row["term_id"])
        return []

    def end(self) -> list[tuple]:
        found = first_indices(self.values, self.target)
        return [(*self.key, k, self.ids[k], self.values[k]) for k in found or []]


def first_subsets(terms: DataFrame, targets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, place, term_id, value): the terms of each group's first solution, by their place in ``order``.

    ``terms``: term_id, keys, value (whole numbers; negative and unknown ones are passed over), ``targets``: keys, target.
    Groups without a solution, with a target of 0 or less, or without a target give no rows. A group's terms lie in one task,
    as numbers; the work is bounded by its terms times its target."""
    names, ranks = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    rows = terms.filter("value >= 0").join(targets.filter("target > 0"), keys)
    rows = rows.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], *[F.col(c).alias(n) for c, n in zip(order, ranks, strict=True)], "term_id", F.col("value").cast("long").alias("value"), F.col("target").cast("long").alias("target"))
    schema = StructType([*[StructField(n, terms.schema[c].dataType) for c, n in zip(keys, names, strict=True)], StructField("place", LongType()), terms.schema["term_id"], StructField("value", LongType())])
    width = len(keys)
    step: Callable[[], _Terms] = lambda: _Terms(width)
    return folded(rows, names, ranks, step, schema).toDF(*keys, "place", "term_id", "value")
