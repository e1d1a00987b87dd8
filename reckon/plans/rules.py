"""The document checks 1000 to 1019 as a registered query, and row keys of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckon.functions import grammar as G
from reckon.operators import rules
from reckon.plans.grammars import _S, _dash
from reckon.plans.registry import query
from reckon.sources.tables import table

K, C = "o_orderkey", "o_custkey"
REGISTER_REVISION = f"CASE {C} % 6 WHEN 0 THEN '07' ELSE concat('0', {C} % 5) END"
#: A wide row for each order: what a page's stamp, title block, name and register say. Most agree, a part doesn't.
FIELDS = {
    "file_name": f"CASE {K} % 11 WHEN 0 THEN 'scan.pdf' WHEN 1 THEN concat('ABCD.287-2879-SOT.OD-0001.pdf_01_RU.pdf') WHEN 2 THEN concat('ABCD.287-2879-SOT.OD-0001_01_RU.dwg') ELSE concat('ABCD.287-2879-SOT.OD-0001.', {K} % 30, '_0', {C} % 5, '_RU.pdf') END",
    "doc_code": f"CASE {K} % 13 WHEN 0 THEN 'АB-1' ELSE concat('AB-', {C}) END",
    "body": f"concat('see AB-', {C} + {K} % 3 % 2, ' of ', o_orderpriority)",
    "revision_stamp": f"concat('0', {C} % 5)",
    "revision_title": f"CASE {K} % 7 WHEN 0 THEN NULL WHEN 1 THEN '09' ELSE concat('0', {C} % 5) END",
    "revision_name": f"concat('0', {C} % 5)",
    "n_layers": f"CASE {K} % 17 WHEN 0 THEN 3 ELSE 0 END",
    "n_annotations": f"CASE {K} % 19 WHEN 0 THEN 1 ELSE 0 END",
    "format_declared": f"concat('A', {K} % 4)",
    "format_real": f"concat('A', {K} % 22 % 4)",
    "formats": f"concat('A', {K} % 4, ',A4')",
    "pages_declared": f"{K} % 6",
    "pages_real": f"{K} % 24 % 6 + CASE {C} % 9 WHEN 0 THEN 1 ELSE 0 END",
    "number_stamp": f"concat({C}, '')",
    "number_title": f"concat({C} + CASE {K} % 23 WHEN 0 THEN 1 ELSE 0 END, '')",
    "number_name": f"concat({C}, '')",
    "page_number": f"{K} % 30",
    "sheet": f"{K} % 60 % 31",
    "title": "o_orderpriority",
    "facility": f"CASE {C} % 10 WHEN 0 THEN o_orderstatus ELSE 'one' END",
    "date_drawn": f"CASE {K} % 12 WHEN 0 THEN 'soon' WHEN 1 THEN NULL ELSE concat(1 + {K} % 28, '.', 1 + {C} % 12, '.2024') END",
    "date_checked": f"CASE {K} % 5 WHEN 0 THEN '1.1.2024' ELSE '31.12.2024' END",
    "page_tokens": f"CASE {K} % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '1, 2' ELSE '1,2,,3' END",
    "issue": f"CASE {K} % 8 WHEN 0 THEN 'IFX' WHEN 1 THEN NULL WHEN 2 THEN 'IFR' ELSE 'IFC' END",
    "mark_stamp": f"concat('SOT', {C} % 3)",
    "mark_name": f"concat('SOT', {K} % 300 % 3)",
}
_X = _dash("file_name")


@query(rf"""
WITH base AS (SELECT o_orderkey, o_custkey, {", ".join(f"{e} AS {n}" for n, e in FIELDS.items())} FROM orders),
 reg AS (SELECT o_custkey AS rc, min(o_orderpriority) AS register_title, {REGISTER_REVISION} AS register_revision, max(concat('A', o_orderkey % 4, ',A4')) AS register_formats FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1),
 x AS (SELECT *, count(DISTINCT facility) OVER (PARTITION BY o_custkey) AS n_facilities, {_X} AS name,
   CASE WHEN regexp_matches(date_drawn, '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}$') THEN strptime(date_drawn, '%d.%m.%Y')::DATE END AS drawn, strptime(date_checked, '%d.%m.%Y')::DATE AS checked FROM base LEFT JOIN reg ON o_custkey = rc),
 bad AS (SELECT o_orderkey, len(regexp_extract_all(name, '{_S}')) <> 1 AS gate, [
   CASE WHEN regexp_matches(doc_code, '[А-Яа-яЁё]') OR regexp_matches(revision_stamp, '[А-Яа-яЁё]') THEN 1001 END, CASE WHEN n_layers > 0 THEN 1002 END, CASE WHEN n_annotations > 0 THEN 1003 END,
   CASE WHEN format_declared <> format_real THEN 1004 END, CASE WHEN coalesce(revision_title, revision_stamp) <> revision_stamp OR revision_name <> revision_stamp THEN 1005 END, CASE WHEN register_revision <> revision_stamp THEN 1006 END,
   CASE WHEN register_formats <> formats THEN 1007 END, CASE WHEN pages_declared <> pages_real THEN 1008 END, CASE WHEN number_stamp <> number_title OR number_name <> number_title THEN 1009 END, CASE WHEN page_number <> sheet THEN 1010 END,
   CASE WHEN register_title <> title THEN 1011 END, CASE WHEN n_facilities > 1 THEN 1012 END, CASE WHEN (date_drawn IS NOT NULL AND drawn IS NULL) OR drawn > checked THEN 1013 END, CASE WHEN NOT contains(body, doc_code) THEN 1014 END,
   CASE WHEN len([t FOR t IN string_split(page_tokens, ',') IF trim(t) <> '']) <> pages_real THEN 1015 END, CASE WHEN NOT ends_with(lower(name), '.pdf') THEN 1016 END, CASE WHEN issue NOT IN ('IFC', 'IFR') THEN 1017 END,
   CASE WHEN mark_stamp <> mark_name THEN 1018 END, CASE WHEN regexp_matches(name, '(?i)[.]pdf_.*[.]pdf$') THEN 1019 END] AS found FROM x)
SELECT o_orderkey, unnest(CASE WHEN gate THEN [1000] ELSE [f FOR f IN found IF f IS NOT NULL] END) AS rule FROM bad
""")
def document_rules(spark, d) -> DataFrame:
    """All checks over all documents in one projection; the register is joined, facilities are counted by kit."""
    orders = table(spark, d, "orders")
    base = orders.select("o_orderkey", "o_custkey", *[F.expr(e).alias(n) for n, e in FIELDS.items()])
    register = orders.filter("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("register_title"), F.max(F.concat(F.lit("A"), (F.col(K) % 4).cast("string"), F.lit(",A4"))).alias("register_formats"))
    register = register.withColumn("register_revision", F.expr(REGISTER_REVISION))
    facilities = base.groupBy("o_custkey").agg(F.countDistinct("facility").alias("n_facilities"))
    wide = base.join(register, "o_custkey", "left").join(facilities, "o_custkey")
    return rules.findings(wide, rules.document_checks(), ["o_orderkey"], gate=1000)


@query("""
WITH f AS (SELECT o_custkey, o_orderstatus || ':' || o_orderpriority AS seed, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n, o_orderkey FROM orders)
SELECT o_orderkey, sha256(o_custkey || '|' || seed || '|' || n) AS row_key, o_orderkey % 7 = 0 AS reviewed FROM f
""")
def review_rows(spark, d) -> DataFrame:
    """Result rows under keys that survive a rerun (seed and its number), with the review flags that were stored by key."""
    orders = table(spark, d, "orders")
    number = F.row_number().over(W.partitionBy("o_custkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderkey"))
    rows = orders.select("o_orderkey", F.sha2(F.concat_ws("|", "o_custkey", F.concat_ws(":", "o_orderstatus", "o_orderpriority"), number), 256).alias("row_key"))
    stored = rows.filter("o_orderkey % 7 = 0").select("row_key").distinct().withColumn("flag", F.lit(True))
    return rows.join(stored, "row_key", "left").select("o_orderkey", "row_key", F.coalesce("flag", F.lit(False)).alias("reviewed"))
