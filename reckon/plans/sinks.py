"""Registered queries of the writers: each writes twice below the shared folder and reads back what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.plans.registry import query
from reckon.sources import sinks
from reckon.sources.tables import table


@query("""
SELECT o_orderkey, o_custkey % 8 AS part, CASE WHEN o_custkey % 8 < 3 THEN -1.0 ELSE o_totalprice END::DOUBLE AS price FROM orders WHERE NOT (o_custkey % 8 < 3 AND o_orderstatus = 'P')
""")
def replaced_partitions(spark, d) -> DataFrame:
    """Three of eight partitions written again without orders in work: they are replaced whole, the others stay."""
    path = sinks.work_folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("part"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    sinks.replace_partitions(o.drop("o_orderstatus"), path, "part")
    sinks.replace_partitions(o.filter("part < 3 and o_orderstatus <> 'P'").withColumn("price", F.lit(-1.0)).drop("o_orderstatus"), path, "part")
    return spark.read.parquet(path).select("o_orderkey", F.col("part").cast("long").alias("part"), "price")


@query("""
SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'first' ELSE 'second' END AS load FROM orders GROUP BY 1
""")
def inserted_once(spark, d) -> DataFrame:
    """Keys of two loads: the second adds only what the first didn't have, however often it is repeated."""
    path = sinks.work_folder(spark)
    o = table(spark, d, "orders")
    sinks.insert_once(o.filter("o_orderstatus = 'O'").select("o_custkey", F.lit("first").alias("load")), path, ["o_custkey"], first=True)
    for _ in range(2):
        sinks.insert_once(o.select("o_custkey", F.lit("second").alias("load")), path, ["o_custkey"])
    return spark.read.parquet(path).select("o_custkey", "load")


@query("""
SELECT o_custkey, coalesce(sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderstatus = 'F'), 0)::DECIMAL(18, 2) AS f, coalesce(sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderstatus = 'O'), 0)::DECIMAL(18, 2) AS o, coalesce(sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderstatus = 'P'), 0)::DECIMAL(18, 2) AS p FROM orders GROUP BY 1
""")
def newest_snapshot(spark, d) -> DataFrame:
    """A wide table written as a snapshot over an older one; the newest is read."""
    path = sinks.work_folder(spark)
    o = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    out = sinks.wide(o, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "price").select("o_custkey", *[F.col(c).cast("decimal(18,2)").alias(c.lower()) for c in "FOP"])
    sinks.write_version(out.withColumn("f", F.lit(0).cast("decimal(18,2)")), path, 1)
    sinks.write_version(out, path, 2)
    return sinks.read_version(spark, path)
