"""Registered queries of cluster placement, apart and mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import placement
from reckon.plans.registry import query
from reckon.sources.tables import table
from reckon.sources.work import Work

KEYS = ["title", "code"]
#: Lines are positions of a supplier's members; records repeat them, with faults for some suppliers.
_BASE = """
 x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey * 100 + month(l_shipdate) * 7 + l_partkey % 7 AS cluster, CASE WHEN l_suppkey % 3 = 0 THEN (l_linenumber % 3)::VARCHAR ELSE CASE p_size % 3 WHEN 0 THEN '9' WHEN 1 THEN '10' ELSE 'x' END END AS member,
   p_type AS title, CASE WHEN l_tax = 0 THEN NULL ELSE (p_size % 3)::VARCHAR END AS code, l_quantity::BIGINT AS quantity, l_suppkey, l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey),
 p AS (SELECT id AS position_id, cluster, member, title, code, quantity FROM x WHERE NOT (l_suppkey % 5 = 1 AND l_discount > 0.09)),
 r AS (SELECT id AS record_id, cluster, title, code, CASE WHEN l_suppkey % 5 = 2 AND l_discount > 0.08 THEN quantity + 1 WHEN l_tax = 0.08 THEN 0 ELSE quantity END AS quantity FROM x WHERE l_suppkey % 5 <> 3 OR l_discount < 0.05),
 m AS (SELECT cluster, title, code, member, sum(quantity) AS had FROM p WHERE code IS NOT NULL GROUP BY ALL), w AS (SELECT cluster, title, code, sum(quantity) AS wanted FROM r WHERE code IS NOT NULL GROUP BY ALL),
 b AS (SELECT coalesce(w.cluster, h.cluster) AS cluster, coalesce(w.title, h.title) AS title, coalesce(w.code, h.code) AS code, coalesce(wanted, 0) AS wanted, coalesce(had, 0) AS had, coalesce(owners, 0) AS owners, owner
   FROM w FULL JOIN (SELECT cluster, title, code, sum(had) AS had, count(*) FILTER (had <> 0) AS owners, min(member) FILTER (had <> 0) AS owner FROM m GROUP BY ALL) h ON w.cluster = h.cluster AND w.title = h.title AND w.code = h.code),
 f AS (SELECT cluster, title, code, CASE WHEN owners = 0 THEN 'no owner' WHEN owners > 1 THEN 'several owners' WHEN had <> wanted THEN 'quantity' END AS fault FROM b WHERE wanted <> 0),
 s AS (SELECT c.cluster, any_value(z.fault) IS NULL AS match, min((f.title, f.code, f.fault)) FILTER (f.fault IS NOT NULL) AS failed FROM (SELECT cluster FROM p UNION SELECT cluster FROM r) c LEFT JOIN f ON f.cluster = c.cluster LEFT JOIN f z ON z.cluster = c.cluster AND z.fault IS NOT NULL GROUP BY 1)"""


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    c = F.col
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_size", "p_type"), "l_partkey")
    size = c("p_size") % 3
    x = x.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_suppkey") * 100 + F.month("l_shipdate") * 7 + c("l_partkey") % 7).alias("cluster"),
        F.when(c("l_suppkey") % 3 == 0, (c("l_linenumber") % 3).cast("string")).when(size == 0, "9").when(size == 1, "10").otherwise("x").alias("member"), c("p_type").alias("title"), F.when(c("l_tax") != 0, size.cast("string")).alias("code"),
        c("l_quantity").cast("long").alias("quantity"), "l_suppkey", "l_discount", "l_tax",
    )
    positions = x.filter(~((c("l_suppkey") % 5 == 1) & (c("l_discount") > 0.09))).select(c("id").alias("position_id"), "cluster", "member", *KEYS, "quantity")
    quantity = F.when((c("l_suppkey") % 5 == 2) & (c("l_discount") > 0.08), c("quantity") + 1).when(c("l_tax") == 0.08, 0).otherwise(c("quantity"))
    return x.filter((c("l_suppkey") % 5 != 3) | (c("l_discount") < 0.05)).select(c("id").alias("record_id"), "cluster", *KEYS, quantity.alias("quantity")), positions


@query(f"""
WITH {_BASE}, alone AS (SELECT m.cluster, m.member, m.title, m.code FROM m JOIN b USING (cluster, title, code) WHERE m.had <> 0 AND wanted = 0)
SELECT r.cluster, 'record' AS side, record_id AS row_id, owner AS label FROM r JOIN b USING (cluster, title, code) JOIN s ON s.cluster = r.cluster WHERE wanted <> 0 AND match
UNION ALL SELECT p.cluster, 'position', position_id, p.member FROM p JOIN s ON s.cluster = p.cluster LEFT JOIN alone a ON a.cluster = p.cluster AND a.member = p.member AND a.title = p.title AND a.code = p.code WHERE NOT match OR a.cluster IS NOT NULL
""")
def placed_apart(spark, d) -> DataFrame:
    """Records on the one member that has their key, or the positions as they are."""
    work = Work(spark)
    return work.finished(placement.separate(*sides(spark, d), KEYS, work)[0])


@query(f"WITH {_BASE} SELECT cluster, CASE WHEN match THEN 'match' ELSE 'mismatch' END AS status, failed[1] AS failed_title, failed[2] AS failed_code, failed[3] AS fault FROM s")
def placement_report(spark, d) -> DataFrame:
    """Each cluster's status, and the least key that is at fault."""
    work = Work(spark)
    return work.finished(placement.separate(*sides(spark, d), KEYS, work)[1])


@query(f"""
WITH {_BASE}, k AS (SELECT *, CASE WHEN wanted <> 0 AND wanted = had THEN 'record' WHEN had <> 0 THEN 'position' END AS place FROM b),
 l AS (SELECT cluster, concat('c', string_agg(member, '/' ORDER BY try_cast(member AS INT) IS NULL, try_cast(member AS INT), member)) AS label FROM (SELECT DISTINCT cluster, member FROM p) GROUP BY 1)
SELECT x.cluster, place AS side, row_id, label FROM (SELECT cluster, title, code, 'record' AS place, record_id AS row_id FROM r UNION ALL SELECT cluster, title, code, 'position', position_id FROM p) x JOIN k USING (cluster, title, code, place) LEFT JOIN l ON l.cluster = x.cluster
""")
def placed_mixed(spark, d) -> DataFrame:
    """All rows of a cluster under one label: records where quantities agree, positions where not."""
    work = Work(spark)
    return work.finished(placement.mixed(*sides(spark, d), KEYS, work, "c")[0])


@query(f"WITH {_BASE} SELECT cluster, title, code, had, wanted, CASE WHEN had <> 0 THEN 'differs' ELSE 'only records' END AS note FROM b WHERE had <> wanted")
def placement_differences(spark, d) -> DataFrame:
    """Keys of mixed clusters whose quantities differ."""
    work = Work(spark)
    return work.finished(placement.mixed(*sides(spark, d), KEYS, work, "c")[1])
