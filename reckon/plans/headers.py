"""Registered query of sheets whose headers lie in different places and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckon.operators import headers
from reckon.plans.registry import query
from reckon.sources.tables import table
from reckon.sources.work import Work

PATTERNS = {"part": r"^(part|material)\b", "line": r"\bline no", "quantity": r"^(quantity|qty)", "flag": r"^flag"}
#: Captions by layout: one row, another order with an older quantity before the one that counts, and two rows.
LAYOUTS = [(["Part number", "Line no.", "Qty", "Flag"], None), (["Flag", "Qty before", "Note", " Material  code ", "qty now", "Line No"], None), (["Line no", "Part", "Quantity", "", "Flag"], ["", "", "plan", "fact", ""])]


def sheets(spark, d) -> DataFrame:
    """A sheet for each supplier: some lines of preamble, a header in one of three layouts, a line of the table in each row."""
    x = table(spark, d, "lineitem")
    layout, skip = F.col("l_suppkey") % 3, F.col("l_suppkey") % 5
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    part, line, quantity = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string"), F.lit(" "))
    flag = F.when(F.col("l_tax") > 0.02, F.col("l_returnflag"))
    data = F.when(layout == 0, F.array(part, line, quantity, flag)).when(layout == 1, F.array(flag, F.lit("7"), F.lit("note"), part, quantity, line)).otherwise(F.array(line, part, F.lit("0"), quantity, flag))
    rows = x.select(F.col("l_suppkey").alias("sheet"), (place + skip + 1).cast("long").alias("row"), data.alias("cells"))
    s = table(spark, d, "supplier").filter("s_suppkey % 11 <> 10").select("s_suppkey", "s_name")
    texts = lambda xs: F.array(*[F.lit(c) for c in xs])
    which = F.col("s_suppkey") % 3
    head = F.when(which == 0, texts(LAYOUTS[0][0])).when(which == 1, texts(LAYOUTS[1][0])).otherwise(texts(LAYOUTS[2][0]))
    sub = texts(LAYOUTS[2][1])
    begin = F.col("s_suppkey") % 5
    preamble = s.select(F.col("s_suppkey").alias("sheet"), F.explode(F.sequence(F.lit(0).cast("long"), begin.cast("long"))).alias("row"), "s_name").filter(F.col("row") < F.col("sheet") % 5).select("sheet", "row", F.array(F.col("s_name"), F.lit("Part list")).alias("cells"))
    heads = s.select(F.col("s_suppkey").alias("sheet"), begin.cast("long").alias("row"), head.alias("cells"))
    subs = s.filter(which == 2).select(F.col("s_suppkey").alias("sheet"), (begin + 1).cast("long").alias("row"), sub.alias("cells"))
    two = (F.col("sheet") % 3 == 2).cast("long")
    return preamble.union(heads).union(subs).union(rows.withColumn("row", F.col("row") + two))


@query("""
SELECT l_suppkey AS sheet, l_partkey::VARCHAR AS part, l_linenumber::VARCHAR AS line, (l_quantity::BIGINT)::VARCHAR AS quantity, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS flag FROM lineitem WHERE l_suppkey % 11 <> 10
""")
def read_sheets(spark, d) -> DataFrame:
    """Lines read back from sheets by their headers; sheets without one give nothing."""
    work = Work(spark)
    got = headers.read_sheets(sheets(spark, d), PATTERNS, ("part", "quantity"), "^(plan|fact)$", work, rightmost=("quantity",))
    return work.finished(got.drop("row"))
