"""Registered queries of pages: clusters of coordinates, texts of boxes, formats and sheet counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import pages
from reckon.plans.registry import query
from reckon.sources.tables import table


@query("""
WITH p AS (SELECT user_id AS page, event_id, round(value, 2)::DECIMAL(10, 2) AS x FROM events), g AS (SELECT *, coalesce((x - lag(x) OVER (PARTITION BY page ORDER BY x, event_id) > 1.5)::INT, 0) AS new FROM p),
 c AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM g)
SELECT page, cluster::BIGINT AS cluster, count(*) AS n, min(x) AS low, max(x) AS high FROM c GROUP BY 1, 2
""")
def line_clusters(spark, d) -> DataFrame:
    """Coordinates of a page clustered by gaps."""
    p = table(spark, d, "events").select(F.col("user_id").alias("page"), F.round("value", 2).cast("decimal(10,2)").alias("x"))
    return pages.gap_clusters(p, ["page"], "x", 1.5).groupBy("page", "cluster").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("""
WITH c AS (SELECT user_id AS page, event_id, value AS x, (event_id % 97)::DOUBLE AS y, event_type[1] AS ch FROM events), b AS (SELECT k, c_custkey AS page, k * 2.5 AS x0, k * 2.0 AS y0 FROM customer, range(0, 40) t(k))
SELECT b.page, k AS box, count(*) AS n, string_agg(ch, '' ORDER BY floor(y / 5), x, event_id) AS text FROM c JOIN b ON b.page = c.page AND x >= x0 AND x < x0 + 20 AND y >= y0 AND y < y0 + 15 GROUP BY 1, 2
""")
def box_texts(spark, d) -> DataFrame:
    """Characters in the boxes of their page, in reading order: lines by height, then from left to right. Pages without
    characters go before their boxes are made."""
    c = F.col
    chars = table(spark, d, "events").select(c("user_id").alias("page"), "event_id", c("value").alias("x"), (c("event_id") % 97).cast("double").alias("y"), F.substring("event_type", 1, 1).alias("ch"))
    k = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("box")
    pages_ = table(spark, d, "customer").select(c("c_custkey").alias("page")).join(chars.select("page").distinct(), "page", "left_semi")
    boxes = pages_.select("page", k).withColumn("box", c("box").cast("long"))
    boxes = boxes.withColumns({"x0": c("box") * 2.5, "y0": c("box") * 2.0}).withColumns({"x1": c("x0") + 20, "y1": c("y0") + 15})
    got = pages.in_boxes(chars, boxes, ["page"], 10.0)
    line = F.sort_array(F.collect_list(F.struct(F.floor(c("y") / 5).alias("l"), "x", "event_id", "ch")))
    return got.groupBy("page", "box").agg(F.count("*").alias("n"), F.array_join(F.transform(line, lambda v: v["ch"]), "").alias("text"))


_W, _H = "CASE o_orderkey % 6 WHEN 0 THEN 210 + o_custkey % 5 WHEN 1 THEN 420 WHEN 2 THEN 594 + o_custkey % 4 WHEN 3 THEN 1189 WHEN 4 THEN 420 ELSE 300 END", "CASE o_orderkey % 6 WHEN 0 THEN 297 WHEN 1 THEN 297 - o_custkey % 5 WHEN 2 THEN 841 WHEN 3 THEN 841 WHEN 4 THEN 594 ELSE 300 END"
_TOKENS = "CASE o_custkey % 6 WHEN 0 THEN 'A4x3, A3' WHEN 1 THEN concat('a1 X ', 1 + o_orderkey % 9) WHEN 2 THEN 'A0,,A9, text' WHEN 3 THEN NULL WHEN 4 THEN 'A2*2' ELSE 'A4' END"
_A4 = "CASE upper(regexp_extract(t, '(?i)^(A[0-9])', 1)) " + " ".join(f"WHEN '{f}' THEN {n}" for f, (_, _, n) in pages.FORMATS.items()) + " ELSE 0 END"


@query(f"""
WITH o AS (SELECT o_orderkey AS id, least({_W}, {_H}) AS s, greatest({_W}, {_H}) AS l, string_split(coalesce({_TOKENS}, ''), ',') AS ts FROM orders),
 n AS (SELECT id, sum({_A4} * coalesce(try_cast(regexp_extract(t, '(?i)^A[0-9]\\s*[xх*]\\s*([0-9]+)$', 1) AS INT), 1))::INT AS sheets FROM (SELECT id, trim(unnest(ts)) AS t FROM o) GROUP BY 1)
SELECT o.id, CASE {" ".join(f"WHEN abs(s - {a}) <= 3 AND abs(l - {b}) <= 3 THEN '{f}'" for f, (a, b, _) in pages.FORMATS.items())} END AS format, sheets FROM o JOIN n USING (id)
""")
def page_formats(spark, d) -> DataFrame:
    """Formats from measured sides, and A4 sheets from lists of formats."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pages.page_format(F.expr(_W), F.expr(_H)).alias("format"), pages.sheet_count(F.expr(_TOKENS)).alias("sheets"))
