"""Registered queries of folders, bundles and subset sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import folders, subset
from reckon.plans.registry import QUERIES, query
from reckon.sources.tables import table
from reckon.sources.work import Work

_PATH = "concat_ws('/', CASE WHEN l_shipdate < DATE '1996-01-01' THEN 'Old' END, concat('S', l_suppkey), CASE WHEN l_quantity > 2 THEN p_brand END, CASE WHEN l_quantity > 6 THEN p_name END, CASE WHEN l_quantity > 12 THEN concat(p_type, l_linenumber) END)"


@query(f"""
WITH f AS (SELECT min(l_orderkey * 10 + l_linenumber) AS folder_id, concat(lower(trim({_PATH})), '/') AS key FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2),
 up AS (SELECT DISTINCT array_to_string(string_split(key, '/')[1:n], '/') || '/' AS key, f.key AS below FROM f, range(1, 8) AS t(n) WHERE n < len(string_split(key, '/')) - 1)
SELECT folder_id, key FROM f WHERE NOT EXISTS (SELECT 1 FROM up JOIN f g ON g.key = up.key WHERE up.below = f.key)
""")
def outermost_folders(spark, d) -> DataFrame:
    """Folders of lines that lie in no other folder."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    work = Work(spark)
    return work.finished(folders.outermost(x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("folder_id"), F.expr(_PATH).alias("path")), work))


_FILES = """SELECT l_orderkey * 10 + l_linenumber AS file_id, concat('s', l_suppkey, '/', l_returnflag, CASE WHEN l_tax > 0.06 THEN '/DWG' WHEN l_tax > 0.05 THEN '/other' ELSE '' END) AS folder, l_suppkey AS title, l_partkey % 5 AS mark, lower(concat(l_linestatus, l_partkey % 7)) AS stem,
  CASE WHEN l_discount < 0.04 THEN 'pdf' WHEN l_discount < 0.06 THEN 'docx' ELSE 'dwg' END AS kind, CASE WHEN l_quantity > 3 THEN {time} END AS time, l_quantity > 45 AS current FROM lineitem"""


def _files(spark, d) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("folder_lines")
    return spark.sql(_FILES.format(time="unix_seconds(CAST(l_shipdate AS TIMESTAMP)) * 1000000000 + l_orderkey").replace("FROM lineitem", "FROM folder_lines"))


_SQL = _FILES.format(time="epoch(l_shipdate)::BIGINT * 1000000000 + l_orderkey")


@query(f"""
WITH f AS ({_SQL}), s AS (SELECT folder, stem, sum(time::HUGEINT) FILTER (time > 0) AS s, count(time) FILTER (time > 0) AS n, count(*) AS c FROM f GROUP BY ALL), t AS (SELECT folder, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
SELECT file_id, CASE WHEN t.n > s.n THEN ((t.s - coalesce(s.s, 0))::HUGEINT // (t.n - s.n)::HUGEINT)::BIGINT END AS mean, (t.n - s.n)::BIGINT AS used, s.c AS skipped FROM f JOIN s USING (folder, stem) JOIN t USING (folder)
""")
def folder_means(spark, d) -> DataFrame:
    """The mean time of each file's folder without the files of its own stem."""
    work = Work(spark)
    return work.finished(folders.means_without_own(_files(spark, d), work))


_KEYS = ["title", "mark", "stem"]


@query(f"""
WITH f AS ({_SQL}), p AS (SELECT title, mark, stem, arg_max(struct_pack(file_id, folder), (current, coalesce(time, 0), -file_id)) AS p FROM f WHERE kind = 'pdf' GROUP BY ALL),
 x AS (SELECT f.*, p.p.file_id AS pid, lower(folder) AS own, lower(p.p.folder) AS home FROM f LEFT JOIN p USING (title, mark, stem)),
 r AS (SELECT *, CASE WHEN kind = 'pdf' THEN CASE WHEN file_id = pid THEN 'primary' ELSE 'extra' END
   WHEN own = home OR (own LIKE '%/dwg' AND (left(own, length(own) - 4) = home OR left(own, length(own) - 4) = regexp_replace(home, '/[^/]*$', ''))) THEN 'paired' ELSE 'unpaired' END AS role FROM x)
SELECT file_id, title, mark, stem, role, CASE WHEN role IN ('primary', 'paired') THEN pid END AS primary_id FROM r
""")
def document_bundles(spark, d) -> DataFrame:
    """What each file is to its document: the primary pdf, paired with it, or neither."""
    work = Work(spark)
    return work.finished(folders.bundles(_files(spark, d), _KEYS, work))


def subset_terms(spark, d) -> DataFrame:
    """The first lines of a supplier's month whose quantities make up two fifths of it. ``tests/test_folders.py`` holds the
    rows against a plain recursion, which SQL can't express."""
    x = table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("term_id"), F.col("l_suppkey").alias("s"), F.date_format("l_shipdate", "yyyyMM").alias("m"), F.col("l_quantity").cast("long").alias("value"))
    targets = x.groupBy("s", "m").agg(F.floor(F.sum("value") * 2 / 5).cast("long").alias("target"))
    return subset.first_subsets(x, targets, ["s", "m"], ["term_id"])


QUERIES["subset_terms"] = subset_terms
