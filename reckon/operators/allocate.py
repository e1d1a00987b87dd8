"""Order-preserving quantity allocation as an overlap of intervals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reckon.operators.fold import folded
from reckon.sources.work import Work


def spans(df: DataFrame, keys: list[str], order: list, quantity: str) -> DataFrame:
    """Adds ``begin`` and ``end``: the stretch of its key's running total that a row stands for."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("end", F.sum(quantity).over(w)).withColumn("begin", F.col("end") - F.col(quantity))


def fifo(demand: DataFrame, supply: DataFrame, keys: list[str], demand_order: list, supply_order: list, demand_quantity: str, supply_quantity: str) -> DataFrame:
    """(keys, demand_id, supply_id, allocated): first come, first served. Both sides are laid end to end; where two stretches
    overlap, the overlap is allocated.

    Every overlap begins where one of its stretches does. So the begins of both sides are put in one order, each takes the
    last stretch of the other side that is open there, and no row is spread over steps or met with all rows of its key."""
    d = spans(demand.filter(F.col(demand_quantity) > 0), keys, demand_order, demand_quantity).select(*keys, "demand_id", F.lit(None).cast(supply.schema["supply_id"].dataType).alias("supply_id"), "begin", "end", F.lit(1).alias("side"))
    s = spans(supply.filter(F.col(supply_quantity) > 0), keys, supply_order, supply_quantity).select(*keys, F.lit(None).cast(demand.schema["demand_id"].dataType).alias("demand_id"), "supply_id", "begin", "end", F.lit(0).alias("side"))
    # at one place supply comes first: a demand meets the supply that begins with it, and not the other way round
    before = W.partitionBy(*keys).orderBy("begin", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    other = lambda side: F.last(F.when(F.col("side") == side, F.struct("demand_id", "supply_id", "end")), ignorenulls=True).over(before)
    met = d.unionByName(s).withColumns({"d": other(1), "s": other(0)}).withColumn("o", F.when(F.col("side") == 1, F.col("s")).otherwise(F.col("d")))
    got = met.filter("o is not null").withColumn("allocated", F.least("end", "o.end") - F.col("begin")).filter("allocated > 0")
    return got.select(*keys, F.coalesce("demand_id", "o.demand_id").alias("demand_id"), F.coalesce("supply_id", "o.supply_id").alias("supply_id"), "allocated")


def left_over(df: DataFrame, pairs: DataFrame, id_column: str, quantity: str, name: str) -> DataFrame:
    """``df`` with ``name``: its quantity without what the pairs took."""
    took = pairs.groupBy(id_column).agg(F.sum("allocated").alias("__took"))
    return df.join(took, id_column, "left").withColumn(name, F.col(quantity) - F.coalesce("__took", F.lit(0))).drop("__took")


def in_phases(demand: DataFrame, supply: DataFrame, phases: list[tuple[str, list[str], Column | None]], demand_order: list, supply_order: list, quantity: str, tag: str = "tag", reserve: tuple[str, ...] = (), work: Work | None = None) -> DataFrame:
    """(demand_id, supply_id, allocated, phase): phases are global, each sees what all rows left over in the ones before.

    A phase is a name, the columns that must agree, and a condition on the supply. In the phases named in ``reserve`` a
    supply whose tag an unfilled demand of the same first key still asks for is passed over."""
    own = work or Work(demand.sparkSession)
    found: list[DataFrame] = []
    demand, supply = demand.withColumn("__left", F.col(quantity)), supply.withColumn("__left", F.col(quantity))
    for name, keys, condition in phases:
        if found:  # what the phase before left over; earlier phases are in its input already
            demand, supply = (own.store(left_over(side.withColumnRenamed("__left", "__had"), found[-1], id_, "__had", "__left").drop("__had")) for side, id_ in ((demand, "demand_id"), (supply, "supply_id")))
        d, s = demand.filter("__left > 0"), supply.filter("__left > 0")
        if condition is not None:
            s = s.filter(condition)
        if name in reserve:
            wanted = d.filter(F.col(tag).isNotNull()).select(keys[0], tag).distinct()
            s = s.join(wanted, [keys[0], tag], "left_anti")
        for k in keys:
            d, s = d.filter(F.col(k).isNotNull()), s.filter(F.col(k).isNotNull())
        got = fifo(d, s, keys, demand_order, supply_order, "__left", "__left")
        found.append(own.store(got.select("demand_id", "supply_id", "allocated", F.lit(name).alias("phase"))))
    out = reduce(DataFrame.unionByName, found)
    return out if work else own.finished(out)


def _all_or_none() -> Callable[[dict], list[tuple]]:
    left = None

    def step(row: dict) -> list[tuple]:
        nonlocal left
        left = int(row["pool"] or 0) if left is None else left
        need = row["need"]
        taken = need if need is not None and 0 < need <= left else 0
        left -= taken
        return [(*(row[k] for k in row if k.startswith("k")), row["demand_id"], need, taken)]

    return step


def whole_or_nothing(demand: DataFrame, pool: DataFrame, keys: list[str], order: list[str], quantity: str, available: str) -> DataFrame:
    """Demand with ``taken``: a row takes all it needs from its key's pool or nothing, and one that doesn't fit doesn't block
    a later, smaller one. What is left hangs on every row before, so a key is folded in order, row by row."""
    names, ranks = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    rows = demand.select(*keys, *[F.col(c).alias(n) for c, n in zip(order, ranks, strict=True)], "demand_id", F.col(quantity).cast("long").alias("need"))
    rows = rows.join(pool.select(*keys, F.col(available).cast("long").alias("pool")), keys, "left").select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], *ranks, "demand_id", "need", "pool")
    schema = StructType([*[StructField(n, demand.schema[c].dataType) for c, n in zip(keys, names, strict=True)], demand.schema["demand_id"], StructField("need", LongType()), StructField("taken", LongType())])
    return folded(rows, names, ranks, _all_or_none, schema).toDF(*keys, "demand_id", "need", "taken")


def contract(demand: DataFrame, supply: DataFrame, keys: list[str], demand_order: list[str], supply_order: list, quantity: str) -> DataFrame:
    """(keys, demand_id, supply_id, allocated, phase): first every demand that the key's whole supply can still fill, all or
    nothing, in order; then what is left of the supply, bit by bit, for the others. Both phases take supply in one order."""
    pool = supply.groupBy(*keys).agg(F.sum(quantity).alias("__pool"))
    work = Work(demand.sparkSession)
    pre = work.store(whole_or_nothing(demand, pool, keys, demand_order, quantity, "__pool").select("demand_id", "taken"))
    both = demand.join(pre, "demand_id")
    whole = fifo(both.filter("taken > 0"), supply, keys, demand_order, supply_order, "taken", quantity)
    gone = both.groupBy(*keys).agg(F.sum("taken").alias("__gone"))
    rest = spans(supply.filter(F.col(quantity) > 0), keys, supply_order, quantity).join(gone, keys).withColumn("__left", F.least(F.col(quantity), F.col("end") - F.col("__gone"))).filter("__left > 0").drop("begin", "end", "__gone")
    part = fifo(both.filter("taken = 0"), rest, keys, demand_order, supply_order, quantity, "__left")
    return work.finished(whole.withColumn("phase", F.lit("whole")).unionByName(part.withColumn("phase", F.lit("partial"))))
