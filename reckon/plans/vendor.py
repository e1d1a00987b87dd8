"""Registered queries of the vendor match. Its rows are tested against a plain greedy walk in ``tests/test_vendor.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import vendor
from reckon.plans.registry import QUERIES
from reckon.sources.tables import table
from reckon.sources.work import release


def sides(spark, d) -> dict[str, DataFrame]:
    """Lines as the five tables of the match: open lines are demand, filled ones of returned and accepted goods vendor rows
    and spare supply, the rest loose supply; a supplier and month is the title, brand and type of the part the code."""
    digits = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    code, tag = F.concat(F.substring("p_type", 1, 1), (digits % 4).cast("string")), F.concat(F.lit("T"), (F.col("p_size") % 3).cast("string"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), code.alias("code"), tag.alias("tag"))
    lineitem = table(spark, d, "lineitem")
    line = lineitem.join(parts, "l_partkey")
    base = line.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.concat_ws("/", F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMM")).alias("title"),
        "code", "tag", F.concat(F.lit("T"), (F.col("l_linenumber") % 3).cast("string")).alias("tag2"),
        F.when(F.col("l_discount") < 0.03, F.array().cast("array<string>")).when(F.col("l_discount") < 0.08, F.array(F.col("l_returnflag"))).otherwise(F.array(F.lit("A"), F.lit("R"))).alias("cabinets"),
        F.when(F.col("l_tax") > 0.06, F.col("l_quantity")).when(F.col("l_tax") > 0.01, F.lit(0.0)).alias("size"), "l_linestatus", "l_returnflag", "l_quantity", "l_tax", "l_discount",
    )
    open_, filled = base.filter("l_linestatus = 'O'"), base.filter("l_linestatus = 'F'")
    has = F.col("l_quantity") < 25
    demand = open_.select(
        F.col("id").alias("demand_id"), "title", F.when(F.col("l_tax") == 0.05, F.array().cast("array<string>")).when(F.col("l_tax") > 0.02, F.array("tag")).otherwise(F.array_distinct(F.array("tag", "tag2"))).alias("tags"),
        F.when(F.col("l_discount") < 0.095, F.col("code")).alias("code"), F.when(has & (F.col("l_tax") < 0.06), F.col("tag2")).alias("supply_tag"), F.when(has, F.col("code")).alias("supply_code"), "cabinets", "size",
    )
    single = F.slice("cabinets", 1, 1)
    vendors = filled.filter("l_returnflag = 'R'").select(F.col("id").alias("vendor_id"), "title", F.when(F.col("l_tax") > 0.01, F.col("tag")).alias("tag"), "code", single.alias("cabinets"), "size")
    spare = filled.filter("l_returnflag = 'A' and l_quantity > 25").select(F.col("id").alias("spare_id"), "title", "tag", "code", single.alias("cabinets"))
    loose = filled.filter("l_returnflag <> 'R' and l_quantity <= 25").select(F.col("id").alias("loose_id"), "title", "code", single.alias("cabinets"), F.floor(F.col("l_quantity") / 8).alias("units"))
    codes = parts.join(lineitem.select("l_partkey").distinct(), "l_partkey", "left_semi").select("code").distinct()
    other = lambda step: F.concat(F.substring("code", 1, 1), ((F.substring("code", 2, 1).cast("int") + step) % 4).cast("string"))
    replacements = codes.filter(F.substring("code", 2, 1).cast("int") < 2).select("code", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), other(s).alias("new_code")) for k, s in enumerate((2, 1))])).alias("x")).select("code", "x.*")
    return {"demand": demand, "vendors": vendors, "spare": spare, "loose": loose, "replacements": replacements}


def vendor_match(spark, d) -> DataFrame:
    """Ten passes between demand, vendor rows and spare supply, and the loose supply that goes with them."""
    return vendor.vendor_match(**sides(spark, d))


QUERIES["vendor_match"] = vendor_match


def vendor_added(spark, d) -> DataFrame:
    """Rows that spare supply and vendors without demand add behind the last demand row of their title."""
    own = sides(spark, d)
    pairs = vendor.vendor_match(**own)
    release(spark)
    return vendor.added_rows(pairs, own["demand"], own["vendors"], own["spare"])


QUERIES["vendor_added"] = vendor_added
