"""Registered queries of send cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import cycles
from reckon.plans.registry import query
from reckon.sources.tables import table

_STAGE = "CASE event_type WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'tdo_passed' ELSE 'incoming_passed' END WHEN 'click' THEN CASE WHEN value > 50 THEN 'tdo_sent' ELSE 'sr_upload' END WHEN 'error' THEN CASE WHEN value > 60 THEN 'code_c' WHEN value > 30 THEN 'code_b' ELSE 'code_a' END ELSE 'other' END"
_REV = "CASE WHEN {0} % 5 = 4 THEN NULL ELSE concat('0', {0} % 5) END"


def sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders are sends of a kit, events are its journal, lines its packages."""
    o = table(spark, d, "orders")
    start = F.lit("2023-12-30").cast("date")
    sent = F.date_add(start, F.pmod(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), F.lit(33)).cast("int"))
    sends = o.select(
        F.col("o_orderkey").alias("send_id"), (F.col("o_custkey") % 150).alias("kit"), F.when(F.col("o_orderpriority") < "4", F.concat(F.lit("n"), (F.floor("o_totalprice") % 40).cast("string"))).alias("number"),
        F.expr(_REV.format("floor(o_totalprice)")).alias("revision"), F.when(F.col("o_orderstatus") != "P", sent).alias("sent"), F.when(F.col("o_orderstatus") == "F", F.date_add(sent, 3)).alias("received"), (F.col("o_orderpriority") == "5-LOW").alias("legalized"),
    )
    e = table(spark, d, "events")
    number = lambda c: F.concat(F.lit("n"), c.cast("string"))
    events = e.select(
        "event_id", F.col("user_id").alias("kit"), F.col("event_id").alias("seq"), F.expr(_STAGE).alias("stage"), F.when(F.col("value") > 80, F.array(number(F.col("event_id") % 40), number(F.col("event_id") % 7))).otherwise(F.array().cast("array<string>")).alias("numbers"),
        F.expr(_REV.format("floor(value)")).alias("revision"), F.when(F.col("value") > 5, F.to_date("ts")).alias("day"),
    )
    packages = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("package_id"), (F.col("l_partkey") % 150).alias("kit"), F.when(F.col("l_linestatus") == "F", "rd").otherwise("sq").alias("source"), (F.col("l_returnflag") == "N").alias("grey"),
        F.expr(_REV.format("l_linenumber")).alias("revision"), F.when(F.col("l_quantity") > 2, F.col("l_quantity").cast("int")).alias("sequence"),
    ).filter("kit % 3 = 0 or grey and kit % 3 = 1")
    return sends, events, packages


_SIDES = f"""
s AS (SELECT o_orderkey AS send_id, o_custkey % 150 AS kit, CASE WHEN o_orderpriority < '4' THEN concat('n', floor(o_totalprice)::BIGINT % 40) END AS number, {_REV.format("floor(o_totalprice)::BIGINT")} AS revision,
  CASE WHEN o_orderstatus <> 'P' THEN DATE '2023-12-30' + ((((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 33) + 33) % 33)::INT) END AS sent, CASE WHEN o_orderstatus = 'F' THEN DATE '2023-12-30' + ((((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 33) + 33) % 33)::INT) + 3 END AS received, o_orderpriority = '5-LOW' AS legalized FROM orders),
 e AS (SELECT event_id, user_id AS kit, event_id AS seq, {_STAGE} AS stage, CASE WHEN value > 80 THEN [concat('n', event_id % 40), concat('n', event_id % 7)] ELSE [] END AS numbers, {_REV.format("floor(value)::BIGINT")} AS revision, CASE WHEN value > 5 THEN ts::DATE END AS day FROM events),
 p AS (SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS package_id, l_partkey % 150 AS kit, CASE WHEN l_linestatus = 'F' THEN 'rd' ELSE 'sq' END AS source, l_returnflag = 'N' AS grey, {_REV.format("l_linenumber")} AS revision, CASE WHEN l_quantity > 2 THEN l_quantity::INT END AS sequence FROM lineitem) WHERE kit % 3 = 0 OR grey AND kit % 3 = 1)"""


@query(f"""
WITH {_SIDES},
 m AS (SELECT send_id, s.kit, s.number, s.revision AS own, s.sent, s.received, e.*, list_position(['tdo_passed', 'incoming_passed', 'tdo_sent', 'incoming_sent', 'sr_upload'], stage) AS strength, stage LIKE 'code%' AS code,
   CASE WHEN list_contains(numbers, number) THEN 1 WHEN s.revision = e.revision THEN 2 WHEN abs(date_diff('day', sent, day)) <= 2 OR abs(date_diff('day', received, day)) <= 2 THEN 3 END AS reason FROM s JOIN e ON s.kit = e.kit),
 a AS (SELECT send_id, min(reason) AS reason, arg_min(event_id, (strength, -seq)) FILTER (strength > 0 AND reason IS NOT NULL) AS best, arg_min(event_id, (strength, -seq)) FILTER (strength > 0 AND revision IS NULL) AS nameless,
   max(seq) FILTER (code AND reason = 1) AS by_number, max(seq) FILTER (code AND reason = 3) AS by_date FROM m GROUP BY 1),
 t AS (SELECT a.*, coalesce(best, nameless) AS accepted_by, x.day AS since FROM a LEFT JOIN e x ON x.event_id = coalesce(best, nameless)),
 r AS (SELECT m.send_id, max(seq) AS by_revision FROM m JOIN t USING (send_id) WHERE code AND own = revision AND (day IS NULL OR number IS NULL OR coalesce(since, received, sent) IS NULL OR day >= coalesce(since, received, sent)) GROUP BY 1),
 k AS (SELECT kit, revision, coalesce(arg_max(package_id, (coalesce(sequence, -1), package_id)) FILTER (source = 'rd' AND NOT grey), min(package_id) FILTER (grey)) AS package_id FROM p WHERE revision IS NOT NULL GROUP BY ALL)
SELECT s.send_id, s.kit, s.revision, CASE WHEN legalized THEN 'legalized' WHEN reason = 1 THEN 'number' WHEN reason = 2 THEN 'revision' WHEN reason = 3 THEN 'date' WHEN package_id IS NOT NULL THEN 'revision' ELSE '' END AS reason, package_id, accepted_by, coalesce(by_number, by_date, by_revision) AS code_event
FROM s LEFT JOIN t USING (send_id) LEFT JOIN r USING (send_id) LEFT JOIN k ON k.kit = s.kit AND k.revision = s.revision
""")
def send_cycles(spark, d) -> DataFrame:
    """Every send with its reason, package, acceptance and code."""
    return cycles.match_cycles(*sides(spark, d))


_KITS = """
 l AS (SELECT kit, arg_max(revision, (coalesce(sent, DATE '0001-01-01'), send_id)) AS official, max((coalesce(sent, DATE '0001-01-01'), send_id)) AS last FROM s WHERE revision IS NOT NULL AND send_id % 3 = 0 GROUP BY 1),
 c AS (SELECT l.kit, l.official, l.last, arg_max(stage, seq) AS stage, arg_max(coalesce(day, DATE '0001-01-01'), seq) AS d, max(seq) AS event_id FROM l JOIN e ON e.kit = l.kit AND coalesce(e.revision, '') = l.official WHERE stage LIKE 'code%' GROUP BY ALL),
 k AS (SELECT kit, official, last, stage, CASE WHEN d > DATE '0001-01-01' THEN d END AS day FROM c)"""


def _kits(sends: DataFrame) -> DataFrame:
    """A kit's official revision, and its last send, of the sends that count as official."""
    at = F.struct(F.coalesce("sent", F.lit("0001-01-01").cast("date")).alias("sent"), "send_id")
    last = sends.filter("revision is not null and send_id % 3 = 0").groupBy("kit").agg(F.max(F.struct(at.alias("at"), "revision")).alias("x"))
    return last.select("kit", F.col("x.revision").alias("official"), F.col("x.at").alias("last"))


@query(f"""
WITH {_SIDES}, {_KITS}, t AS (SELECT k.kit, bool_or(s.revision > k.official) AS higher, arg_min(coalesce(s.revision, '-'), (coalesce(s.sent, DATE '0001-01-01'), s.send_id)) AS first_
   FROM k JOIN s ON s.kit = k.kit WHERE CASE WHEN k.day IS NOT NULL AND s.sent IS NOT NULL THEN s.sent > k.day ELSE (coalesce(s.sent, DATE '0001-01-01'), s.send_id) > k.last END GROUP BY 1),
 g AS (SELECT DISTINCT k.kit FROM k JOIN p ON p.kit = k.kit WHERE source = 'rd' AND NOT grey AND coalesce(p.revision, '') > k.official AND (k.day IS NULL OR package_id % 4 = 0 OR DATE '2024-01-01' + (package_id % 30)::INT > k.day))
SELECT k.kit, CASE WHEN stage = 'code_a' OR higher THEN 'customer' WHEN first_ = official THEN 'pi' WHEN g.kit IS NOT NULL THEN 'customer' ELSE 'unknown' END AS origin FROM k LEFT JOIN t USING (kit) LEFT JOIN g ON g.kit = k.kit
""")
def code_origin(spark, d) -> DataFrame:
    """Whose code the last one on each kit's official revision is. Revisions are numbers here, so their text ranks them."""
    sends, events, packages = sides(spark, d)
    kits = _kits(sends)
    codes = cycles.last_code_of(kits, events).join(kits.withColumnRenamed("official", "revision"), "kit")
    modified = F.when(F.col("package_id") % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("package_id") % 30).cast("int")).cast("timestamp"))
    return cycles.code_origins(codes, sends, packages.withColumn("modified", modified), lambda c: c)


@query(f"""
WITH {_SIDES}, {_KITS}, w AS (SELECT kit, official, NULL AS wanted FROM l UNION ALL SELECT kit, official, official FROM l UNION ALL SELECT kit, official, '02' FROM l WHERE official <> '02'),
 x AS (SELECT w.kit, wanted, official, package_id, coalesce(sequence, -1) AS n, coalesce(revision = wanted, FALSE) AS named, coalesce(CASE WHEN package_id % 3 = 0 THEN concat('0', package_id % 4) END = wanted, FALSE) AS material FROM w JOIN p ON p.kit = w.kit WHERE source = 'rd' AND NOT grey AND package_id % 7 <> 0),
 y AS (SELECT *, CASE WHEN wanted IS NULL THEN 0 WHEN wanted = official THEN CASE WHEN material THEN 2 WHEN named THEN 1 ELSE 0 END WHEN named THEN 0 END AS tier FROM x)
SELECT kit, wanted, arg_max(package_id, (tier, n, package_id)) AS package_id FROM y WHERE tier IS NOT NULL GROUP BY ALL
""")
def picked_packages(spark, d) -> DataFrame:
    """The issued package of no revision in particular, of each kit's official one, and of an older one."""
    sends, _, packages = sides(spark, d)
    kits = _kits(sends).select("kit", "official")
    wanted = kits.withColumn("wanted", F.lit(None).cast("string")).union(kits.withColumn("wanted", F.col("official"))).union(kits.filter("official <> '02'").withColumn("wanted", F.lit("02")))
    material = F.when(F.col("package_id") % 3 == 0, F.concat(F.lit("0"), (F.col("package_id") % 4).cast("string")))
    return cycles.pick_packages(wanted, packages.withColumns({"material_revision": material, "skipped": F.col("package_id") % 7 == 0}))
