"""Registered queries of replies to letters, and of journals that letters edit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions import replies as R
from reckon.operators import journal, replies
from reckon.plans import letters
from reckon.plans.cycles import _REV, _STAGE
from reckon.plans.registry import QUERIES, query
from reckon.sources.tables import table


def answers(spark, d) -> DataFrame:
    """A reply for each order: the reviewed documents in its answer, the others in the quoted letter, prose in dear ones."""
    table(spark, d, "lineitem").createOrReplaceTempView("letter_lines")
    one = spark.sql(letters._ONE.format(lines=letters._LINES.format(text="STRING").replace("FROM lineitem", "FROM letter_lines"))).withColumn("p", F.split("x", r"\|"))
    number, name, revision, code = F.col("n").cast("string"), letters.written(F.get("p", F.lit(0))), F.get("p", F.lit(1)), F.get("p", F.lit(2))
    above = F.when(code == "A", F.concat(name, F.lit("_"), revision, F.lit("_RU.pdf")))
    below = F.when(code == "", F.concat(number, F.lit(" "), name, F.lit(" "), revision, F.lit(" title")))
    texts = one.groupBy("id").agg(*[F.array_join(F.array_compact(F.array_sort(F.collect_list(F.struct("n", t.alias("t"))))["t"]), "\n").alias(a) for a, t in (("above", above), ("below", below))])  # a letter's lines: seven at most
    o = table(spark, d, "orders").join(texts, F.col("o_orderkey") == F.col("id"), "left")
    words = F.when(F.col("o_orderstatus") == "F", "Документы загружены в СР").when(F.col("o_orderstatus") == "O", "Документация принята").otherwise("Спасибо")
    incoming = F.when(F.col("o_totalprice") > 150000, F.concat(F.lit(" IN-TRM-"), F.col("o_orderkey").cast("string"))).otherwise("")
    prose = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("по титулу 6816 марка\nKSB рев.0"), F.when(F.col("o_orderpriority") < "3", "").otherwise(", по титулу 6816 марка ksb рев. 1"))).otherwise("")
    body = F.concat(words, incoming, F.lit("\r\n"), F.coalesce("above", F.lit("")), F.lit("\nFrom: somebody\nOwner document number\n"), F.coalesce("below", F.lit("")), F.lit("\n"), prose)
    subject = F.concat(F.lit("RE: letter"), F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit(" AB-TRM-"), F.col("o_custkey").cast("string"))).otherwise(""))
    return o.select(F.col("o_orderkey").alias("id"), subject.alias("subject"), body.alias("body"))


def sends(spark, d) -> DataFrame:
    """Open dear orders send kits."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'O' and o_totalprice > 200000")
    return o.select(F.concat(F.lit("ab-trm-"), F.col("o_custkey").cast("string")).alias("transmittal"), (1000 + F.floor("o_totalprice") % 9000).cast("string").alias("title"), F.lit("SOT").alias("mark"), "o_orderdate", "o_orderkey")


@query(f"""
WITH x AS (SELECT id, n, string_split(x, '|') AS p FROM ({letters._ONE.format(lines=letters._LINES.format(text="VARCHAR"))})), l AS (SELECT id, n, p[2] AS revision, p[3] AS code, substr(p[1], 10, 4) AS title FROM x),
 a AS (SELECT id, count(*) FILTER (code = 'A') AS above, count(DISTINCT title) FILTER (code = 'A') AS above_kits, min(title) FILTER (code = 'A') AS above_title, coalesce(max(revision) FILTER (code = 'A' AND n = 2), arg_min(revision, n) FILTER (code = 'A')) AS above_revision,
   count(*) FILTER (code = '') AS below, count(DISTINCT title) FILTER (code = '') AS below_kits, min(title) FILTER (code = '') AS below_title, coalesce(max(revision) FILTER (code = '' AND n = 2), arg_min(revision, n) FILTER (code = '')) AS below_revision FROM l GROUP BY 1),
 s AS (SELECT o_custkey AS c, arg_max((1000 + floor(o_totalprice)::BIGINT % 9000)::VARCHAR, (o_orderdate, o_orderkey)) AS title FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 GROUP BY 1),
 m AS (SELECT o.*, a.*, s.title AS sent, o_priority <> '5-LOW' AS named, CASE WHEN above > 0 THEN 'above' WHEN below_kits = 1 THEN 'below' WHEN o_totalprice > 300000 THEN 'prose' WHEN o_priority <> '5-LOW' AND s.title IS NOT NULL THEN 'sent' ELSE '' END AS way
   FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority AS o_priority FROM orders) o LEFT JOIN a ON a.id = o_orderkey LEFT JOIN s ON s.c = o_custkey),
 e AS (SELECT *, CASE WHEN way = 'above' AND above_kits > 1 THEN 'several kits' WHEN way <> '' THEN '' WHEN named THEN 'no kit of the transmittal' ELSE 'no transmittal' END AS error FROM m)
SELECT o_orderkey AS id, CASE WHEN named THEN concat('AB-TRM-', o_custkey) END AS transmittal, CASE WHEN o_totalprice > 150000 THEN concat('IN-TRM-', o_orderkey) END AS incoming,
 CASE WHEN error = '' THEN CASE o_orderstatus WHEN 'O' THEN 'incoming_passed' WHEN 'F' THEN CASE WHEN o_totalprice > 150000 THEN 'incoming_passed' ELSE 'sr_upload' END END END AS stage,
 CASE way WHEN 'above' THEN CASE WHEN above_kits = 1 THEN above_title END WHEN 'below' THEN below_title WHEN 'prose' THEN '6816' WHEN 'sent' THEN sent END AS title, CASE WHEN way = 'above' AND above_kits > 1 THEN NULL WHEN way = 'prose' THEN 'KSB' WHEN way <> '' THEN 'SOT' END AS mark,
 CASE way WHEN 'above' THEN above_revision WHEN 'below' THEN below_revision WHEN 'prose' THEN CASE WHEN o_priority < '3' THEN '0' END END AS revision, CASE way WHEN 'above' THEN above WHEN 'below' THEN below ELSE 0 END::INT AS documents,
 CASE WHEN way IN ('above', 'below', 'prose') THEN 'text' WHEN way = 'sent' THEN 'transmittal' END AS kit_by, error FROM e
""")
def mail_replies(spark, d) -> DataFrame:
    """Stage, transmittals, kit and revision of every reply; kits that a reply doesn't name come from its transmittal."""
    read = answers(spark, d).select("id", R.reply(F.col("subject"), F.col("body"), "ABCD").alias("x")).select("id", "x.*")
    return replies.resolved(read, sends(spark, d), ["o_orderdate", "o_orderkey"])


def sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers are kits, their orders the lines of the journals, events of the users the letters."""
    c = table(spark, d, "customer").filter("c_acctbal > -500")
    cells = c.select(F.col("c_custkey").alias("kit"), F.when(F.col("c_acctbal") > 2000, F.concat(F.lit("Рев. "), (F.floor(F.abs("c_acctbal")) % 5).cast("string"))).otherwise("").alias("revision"), F.when(F.col("c_mktsegment") < "C", "рд согласовано").otherwise("").alias("status"))
    o = table(spark, d, "orders")
    day = F.date_add(F.lit("2023-12-28").cast("date"), F.pmod(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), F.lit(40)).cast("int"))
    dated = F.when(F.col("o_totalprice") > 200000, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "d.M.yyyy"))
    number = F.concat(F.lit(" N-TRM-"), (F.floor("o_totalprice") % 7).cast("string"))
    words = F.when(F.col("o_orderpriority") < "2", "").when(F.col("o_orderpriority") < "3", number).when(F.col("o_orderstatus") == "F", F.concat(F.lit(" код А на рев. 0"), (F.floor("o_totalprice") % 5).cast("string"), number)).when(F.col("o_orderstatus") == "O", " отпр на ТДО").otherwise(" звонок")
    lines = o.select(F.col("o_custkey").alias("kit"), F.col("o_orderkey").alias("position"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000), F.lit("без даты")).otherwise(F.concat(dated, words)).alias("line"))
    e = table(spark, d, "events")
    sent = e.select(
        F.col("user_id").alias("kit"), F.col("event_id").alias("letter_id"), F.col("event_id").alias("position"), F.when(F.col("value") > 2, F.to_date("ts")).alias("date"), F.expr(_STAGE).alias("stage"), F.expr(_REV.format("floor(value)")).alias("revision"),
        F.when(F.col("value") > 20, F.concat(F.lit("N-TRM-"), (F.floor("value") % 7).cast("string"))).alias("transmittal"), F.when(F.col("value") > 90, F.lit("02")).alias("file_revision"), (F.col("value") < 10).alias("file_absent"),
    )
    return cells, lines, sent


def journal_writes(spark, d) -> DataFrame:
    """What every letter does to the journal of its kit, and all journals after that."""
    return journal.written(*sides(spark, d), ["kit"])


QUERIES["journal_writes"] = journal_writes
