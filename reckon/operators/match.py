"""Consumable one-to-one matching: each demand row takes at most one supply row, each supply row is used once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from reckon.operators.fold import Shelf, folded
from reckon.sources.work import Work

#: Larger than any size.
HUGE = 1.7e308


def ranked_pass(demand: DataFrame, supply: DataFrame, on: list[tuple[str, str]], demand_order: list, supply_order: list) -> DataFrame:
    """(demand_id, supply_id): the i-th demand row of a key meets its i-th supply row. Greedy matching in order, without its
    loop: one window on each side and one equi-join on (key, rank), which never meets all pairs of a key."""
    d = demand.select("demand_id", *[F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(on)], F.row_number().over(W.partitionBy(*[a for a, _ in on]).orderBy(*demand_order)).alias("r"))
    s = supply.select("supply_id", *[F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(on)], F.row_number().over(W.partitionBy(*[b for _, b in on]).orderBy(*supply_order)).alias("r"))
    return d.join(s, [*[f"k{i}" for i in range(len(on))], "r"]).select("demand_id", "supply_id")


def _free(side: DataFrame, done: DataFrame | None, id_: str) -> DataFrame:
    return side if done is None else side.join(done.select(id_), id_, "left_anti")


def passes(demand: DataFrame, supply: DataFrame, plan: list[tuple[str, list[tuple[str, str]]]], demand_order: list, supply_order: list, work: Work | None = None, done: DataFrame | None = None) -> DataFrame:
    """Several passes in turn; each sees only what is still free on both sides. Adds the pass's name. The pairs of a pass are
    stored, so that none is worked out again by those behind it."""
    own = work or Work(demand.sparkSession)
    for name, on in plan:
        keys_d, keys_s = ([F.col(k).isNotNull() for k in ks] for ks in zip(*on))
        free_d, free_s = _free(demand, done, "demand_id"), _free(supply, done, "supply_id")
        pairs = ranked_pass(free_d.filter(reduce(Column.__and__, keys_d)), free_s.filter(reduce(Column.__and__, keys_s)), on, demand_order, supply_order)
        pairs = own.store(pairs.withColumn("pass", F.lit(name)))
        done = pairs if done is None else done.union(pairs)
    return done if work else own.finished(done)


def outcome(demand: DataFrame, supply: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every row of both sides once: matched pairs with their pass, ``unmatched`` demand and ``supply only`` rows."""
    left = demand.select("demand_id").join(pairs, "demand_id", "left").select("demand_id", "supply_id", F.coalesce("pass", F.lit("unmatched")).alias("pass"))
    right = supply.select("supply_id").join(pairs.select("supply_id"), "supply_id", "left_anti").select(F.lit(None).cast(demand.schema["demand_id"].dataType).alias("demand_id"), "supply_id", F.lit("supply only").alias("pass"))
    return left.union(right)


def _first_within(forward: bool) -> Callable[[], Callable[[dict], list[tuple]]]:
    """The fold of :func:`guarded`: the supply of a key comes first, then its demand."""

    def start() -> Callable[[dict], list[tuple]]:
        ids, sizes, shelf, at = [], [], None, 0

        def step(row: dict) -> list[tuple]:
            nonlocal shelf, at
            if row["side"] == 0:
                ids.append(row["supply_id"])
                sizes.append(row["size"])
                return []
            if shelf is None:  # a supply of unknown size fits an open demand only
                shelf = Shelf([HUGE if s is None else s for s in sizes])
            place = shelf.first(row["size"] or HUGE, at)
            if place < 0:
                return []
            shelf.take(place)
            at = place + 1 if forward else 0
            return [(row["demand_id"], ids[place])]

        return step

    return start


def guarded(demand: DataFrame, supply: DataFrame, on: list[tuple[str, str]], demand_order: list[str], supply_order: list[str], quantity: str, forward: bool = True) -> DataFrame:
    """(demand_id, supply_id): in order, each demand row takes the first supply row of its key that isn't larger than it; a
    demand of 0, or an unknown one, takes any. ``forward``: the search goes on behind the last row taken, so what was passed
    over is lost to later demand; otherwise it starts anew over what isn't taken.

    What a row takes hangs on every row before it, so a key is folded in order, its demand as it comes over a tree of minima
    of its supply: each step takes the logarithm of the key's rows. A null key matches nothing."""
    names = [f"k{i}" for i in range(len(on))]
    order = [f"o{i}" for i in range(len(supply_order) + len(demand_order))]
    ids = {"demand_id": demand.schema["demand_id"].dataType, "supply_id": supply.schema["supply_id"].dataType}

    def side(df: DataFrame, number: int, columns: list[str], id_: str) -> DataFrame:
        ranks = [F.col(c) if mine else F.lit(None) for mine, c in [*((number == 0, c) for c in supply_order), *((number == 1, c) for c in demand_order)]]
        own = [F.col(n) if n == id_ else F.lit(None).cast(kind).alias(n) for n, kind in ids.items()]
        return df.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.lit(number).alias("side"), *[r.alias(n) for r, n in zip(ranks, order, strict=True)], *own, F.col(quantity).cast("double").alias("size")).dropna(subset=names)

    rows = side(supply, 0, [b for _, b in on], "supply_id").union(side(demand, 1, [a for a, _ in on], "demand_id"))
    return folded(rows, names, ["side", *order], _first_within(forward), StructType([StructField(n, k) for n, k in ids.items()]))


def consume(demand: DataFrame, supply: DataFrame, demand_order: list[str], supply_order: list[str], quantity: str, tag: str = "tag", code: str = "code", replacement: str = "new_code") -> DataFrame:
    """(demand_id, supply_id, pass): the five passes of the consumable match. By tag with the code, the demand's replacement
    and the supply's replacement; then by code, moving forward, and by replacement, each with the size guard. Every pass sees
    only what is still free on both sides."""
    tagged = [("tag and code", [(tag, tag), (code, code)]), ("tag and replacement", [(tag, tag), (replacement, code)]), ("tag and reverse replacement", [(tag, tag), (code, replacement)])]
    work = Work(demand.sparkSession)
    demand, supply = work.store(demand), work.store(supply)
    found = passes(demand, supply, tagged, demand_order, supply_order, work)
    for name, on, forward in (("code", [(code, code)], True), ("replacement", [(replacement, code)], False)):
        free_d, free_s = _free(demand, found, "demand_id"), _free(supply, found, "supply_id")
        found = found.union(work.store(guarded(free_d, free_s, on, demand_order, supply_order, quantity, forward).withColumn("pass", F.lit(name))))
    return work.finished(found)
