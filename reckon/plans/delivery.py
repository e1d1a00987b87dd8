"""Registered queries of the delivery's leftovers. Rows are tested against a plain queue in ``tests/test_delivery.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import allocate, delivery
from reckon.plans.registry import QUERIES
from reckon.sources.tables import table
from reckon.sources.work import Work

KEYS = ["title", "code"]


def sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Demand of the global phases, rows of the two blocks, and units: lines of a supplier's month and part size."""
    line = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    base = line.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.concat_ws("/", F.col("l_suppkey").cast("string"), F.year("l_shipdate").cast("string")).alias("title"), (F.col("p_size") % 5).cast("string").alias("code"), F.col("l_returnflag").alias("actual"),
        F.when(F.col("l_discount") > 0.02, F.concat(F.lit("T"), F.col("l_linenumber").cast("string"))).alias("tag"), F.concat(F.lit("T"), (F.col("l_linenumber") + 1).cast("string")).alias("tag2"), F.col("l_quantity").cast("long").alias("quantity"), "l_linestatus", "l_tax",
    )
    tags = F.when(F.col("tag").isNull(), F.array().cast("array<string>")).when(F.col("l_tax") > 0.04, F.array("tag", "tag2")).otherwise(F.array("tag"))
    open_ = base.filter("l_linestatus = 'O'")
    demand = open_.filter("l_tax < 0.025").select(F.col("id").alias("demand_id"), *KEYS, "actual", "tag", "quantity")
    rows = open_.filter("l_tax >= 0.025").select(F.col("id").alias("row_id"), F.when(F.col("l_tax") < 0.055, 1).otherwise(2).alias("block"), *KEYS, tags.alias("tags"), "quantity")
    return demand, rows, base.filter("l_linestatus = 'F'").select(F.col("id").alias("supply_id"), *KEYS, "actual", "tag", "quantity")


def rest_of(demand: DataFrame, units: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The pairs of the global phases, within a supplier, and the units with what these leave over."""
    own = [*KEYS, "actual"]
    phases = [("tag", [*own, "tag"], None), ("untagged", own, F.col("tag").isNull()), ("any", own, None)]
    pairs = allocate.in_phases(demand, units, phases, ["demand_id"], ["supply_id"], "quantity", reserve=("any",), work=work)
    rest = allocate.left_over(units, pairs, "supply_id", "quantity", "rest")
    return pairs, work.store(rest.select(F.col("supply_id").alias("unit_id"), *KEYS, "actual", "tag", F.col("rest").cast("double").alias("quantity")).filter("quantity > 0"))


def delivery_leftovers(spark, d) -> DataFrame:
    """What rows of two blocks take of the units that the global phases leave over, and what is left then."""
    demand, rows, units = sides(spark, d)
    work = Work(spark)
    _, rest = rest_of(demand, units, work)
    return work.finished(delivery.leftovers(rest, rows, KEYS, ["actual", "unit_id"], ["row_id"]))


def delivery_created(spark, d) -> DataFrame:
    """Rows made for the units that nobody takes."""
    demand, rows, units = sides(spark, d)
    work = Work(spark)
    _, rest = rest_of(demand, units, work)
    return work.finished(delivery.created(delivery.leftovers(rest, rows, KEYS, ["actual", "unit_id"], ["row_id"]), rest, KEYS))


QUERIES |= {"delivery_leftovers": delivery_leftovers, "delivery_created": delivery_created}
