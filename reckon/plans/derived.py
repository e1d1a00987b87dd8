"""Registered queries of derived tables that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import derived
from reckon.plans.registry import query
from reckon.sources.tables import table
from reckon.sources.work import Work

BUCKETS = 16
#: Two states of the orders: some are new, some gone, some have another price; a few customers lose all of theirs.
_OLD = "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, o_orderdate FROM orders WHERE o_custkey % 40 <> 1"
_NEW = "SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 25 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus, o_orderdate FROM orders WHERE o_custkey % 40 <> 2"


def _states(spark, d) -> tuple[DataFrame, DataFrame]:
    table(spark, d, "orders").createOrReplaceTempView("derived_orders")
    old, new = (spark.sql(q.replace("FROM orders", "FROM derived_orders")) for q in (_OLD, _NEW))
    return old, new


def kits(orders: DataFrame):
    """Derives a row for each customer, from all orders or from those of some."""

    def derive(keys: DataFrame | None) -> DataFrame:
        own = orders if keys is None else orders.join(keys.select(F.col("o_custkey").alias("k")), F.col("o_custkey") == F.col("k"), "left_semi")
        return own.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total"), F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).getField("o_orderstatus").alias("last_status"))

    return derive


@query(f"WITH n AS ({_NEW}) SELECT o_custkey, count(*) AS orders, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(18, 2) AS total, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM n GROUP BY 1")
def rebuilt_kits(spark, d) -> DataFrame:
    """A derived table of the old state, brought up to date for the customers whose orders differ; SQL works it out anew."""
    old, new = _states(spark, d)
    work = Work(spark)
    path = f"{work.base}/kits"
    derived.build(kits(old), path, "o_custkey", BUCKETS)
    derived.rebuild(kits(new), derived.dirty_keys(old, new, "o_custkey"), path, "o_custkey", BUCKETS, work)
    return work.finished(spark.read.parquet(path).drop("bucket"))


_FILES = "SELECT page_id AS file_id, CASE WHEN page_id % 10 = {0} THEN concat(url, '/moved') ELSE url END AS path, CASE WHEN page_id % 7 = {0} THEN 'sq' ELSE 'rd' END AS source FROM pages WHERE page_id % 13 <> {0}"
_JUDGE = "source <> 'rd' OR path LIKE '%example.com/en/%' OR path LIKE '%/moved'"


@query(f"WITH f AS ({_FILES.format(2)}) SELECT file_id, path, source, coalesce({_JUDGE}, FALSE) AS member FROM f")
def contour_members(spark, d) -> DataFrame:
    """Which files count: those of a second scan, where only new and moved ones are judged again."""
    table(spark, d, "pages").createOrReplaceTempView("derived_pages")
    first, second = (spark.sql(_FILES.format(k).replace("FROM pages", "FROM derived_pages")) for k in (1, 2))
    work = Work(spark)
    before = work.store(derived.members(first, None, F.expr(_JUDGE)))
    return work.finished(derived.members(second, before, F.expr(_JUDGE)))
