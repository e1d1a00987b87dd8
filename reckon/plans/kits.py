"""Registered queries of kit statuses: review cycles, origins, revision tiers, working revisions, lateness with overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions import grammar as G
from reckon.functions import keys
from reckon.plans.grammars import _APP, _REV, CELL
from reckon.plans.registry import query
from reckon.sources.tables import table

#: The driver's orders lie in other years than its events; sends get a day in the events' month.
_DAY = "DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT)"


def _day(days: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))


@query(f"""
WITH sends AS (SELECT o_custkey AS kit, {_DAY} AS day0, o_orderkey AS n, o_orderstatus = 'F' AS accepted FROM orders WHERE o_custkey % 10 <> 0), last AS (SELECT kit, max((day0, n)) AS m FROM sends GROUP BY 1),
 cycle AS (SELECT l.kit, m[1] AS day0, s.accepted FROM last l JOIN sends s ON s.kit = l.kit AND s.n = m[2]),
 ev AS (SELECT user_id AS kit, ts::DATE AS day, CASE WHEN event_type = 'purchase' AND value > 70 THEN 'agreed' WHEN event_type = 'purchase' THEN 'passed' WHEN event_type = 'click' THEN 'sent' END AS stage FROM events),
 k AS (SELECT kit FROM cycle UNION SELECT kit FROM ev UNION SELECT c_custkey FROM customer),
 x AS (SELECT k.kit, any_value(c.day0) AS day0, bool_or(c.accepted) AS accepted, coalesce(bool_or(e.stage = 'agreed' AND (c.day0 IS NULL OR e.day >= c.day0)), FALSE) AS agreed, coalesce(bool_or(e.stage = 'passed' AND (c.day0 IS NULL OR e.day >= c.day0)), FALSE) AS passed, coalesce(bool_or(e.stage = 'sent'), FALSE) AS sent
  FROM k LEFT JOIN cycle c ON c.kit = k.kit LEFT JOIN ev e ON e.kit = k.kit GROUP BY 1)
SELECT kit, CASE WHEN agreed THEN 'agreed' WHEN coalesce(accepted, FALSE) OR passed THEN 'review' WHEN day0 IS NOT NULL OR sent THEN 'sent' ELSE 'not uploaded' END AS status FROM x
""")
def kit_review_status(spark, d) -> DataFrame:
    """Each kit's status in its current cycle, which begins with its last send. Events of earlier cycles no longer count;
    the last of each stage is found before they meet the sends. Every tenth kit was never sent."""
    c = F.col
    sends = table(spark, d, "orders").filter("o_custkey % 10 <> 0").groupBy(c("o_custkey").alias("kit")).agg(F.max(F.struct(_day(c("o_orderkey") % 30).alias("at"), c("o_orderkey").alias("n"), (c("o_orderstatus") == "F").alias("accepted"))).alias("last")).select("kit", "last.at", "last.accepted")
    stage = F.when((c("event_type") == "purchase") & (c("value") > 70), "agreed").when(c("event_type") == "purchase", "passed").when(c("event_type") == "click", "sent")
    last_of = lambda s: F.max(F.when(stage == s, F.to_date("ts"))).alias(f"{s}_day")
    events = table(spark, d, "events").groupBy(c("user_id").alias("kit")).agg(last_of("agreed"), last_of("passed"), last_of("sent"))
    every = table(spark, d, "customer").select(c("c_custkey").alias("kit")).union(sends.select("kit")).union(events.select("kit")).distinct()
    x = every.join(sends, "kit", "left").join(events, "kit", "left")
    now = lambda s: c(f"{s}_day").isNotNull() & (c("at").isNull() | (c(f"{s}_day") >= c("at")))
    status = F.when(now("agreed"), "agreed").when(F.coalesce("accepted", F.lit(False)) | now("passed"), "review").when(c("at").isNotNull() | c("sent_day").isNotNull(), "sent").otherwise("not uploaded")
    return x.select("kit", status.alias("status"))


_ROBOT, _RD, _SQ = "o_orderkey % 30", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 30 END", "CASE WHEN o_custkey % 11 < 3 THEN NULL ELSE (o_orderkey + o_custkey) % 30 END"


@query(f"""
WITH x AS (SELECT o_orderkey AS id, abs({_ROBOT} - ({_RD})) AS rd, abs({_ROBOT} - ({_SQ})) AS sq, o_orderstatus = 'F' AS equal FROM orders)
SELECT id, CASE WHEN rd IS NULL AND sq IS NULL THEN 'no date' WHEN least(coalesce(rd, 99), coalesce(sq, 99)) > 3 THEN 'none' WHEN coalesce(rd, 99) = coalesce(sq, 99) THEN CASE WHEN equal THEN 'catalog' ELSE 'request' END WHEN coalesce(rd, 99) < coalesce(sq, 99) THEN 'catalog' ELSE 'request' END AS origin FROM x
""")
def nearest_origin(spark, d) -> DataFrame:
    """Which of two files a third one comes from: the nearer date within three days, equal content decides a tie."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[F.abs(F.expr(_ROBOT) - F.expr(e)).alias(n) for n, e in (("rd", _RD), ("sq", _SQ))], (F.col("o_orderstatus") == "F").alias("equal"))
    rd, sq = F.coalesce("rd", F.lit(99)), F.coalesce("sq", F.lit(99))
    tie = F.when(F.col("equal"), "catalog").otherwise("request")
    origin = F.when(F.col("rd").isNull() & F.col("sq").isNull(), "no date").when(F.least(rd, sq) > 3, "none").when(rd == sq, tie).when(rd < sq, "catalog").otherwise("request")
    return x.select("id", origin.alias("origin"))


@query(f"""
WITH c AS (SELECT o_orderkey AS id, o_custkey, {CELL} AS cell FROM orders), r AS (SELECT id, {_REV} AS rev, {_APP} AS app, lpad((o_custkey % 4)::VARCHAR, 2, '0') AS want, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE (o_custkey % 5)::VARCHAR END AS want_app FROM c)
SELECT id, CASE WHEN rev = want AND coalesce(try_cast(app AS INT), -1) = coalesce(try_cast(want_app AS INT), -1) THEN 2 WHEN rev = want THEN 1 ELSE 0 END AS tier FROM r
""")
def revision_tiers(spark, d) -> DataFrame:
    """How well a revision cell fits an approved one: 2 with the appendix, 1 without, 0 not."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), G.sheet_revision(F.expr(CELL)).alias("r"), F.lpad((F.col("o_custkey") % 4).cast("string"), 2, "0").alias("want"), F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 5).cast("string")).alias("want_app"))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(-1))
    base = F.coalesce(F.col("r.revision") == F.col("want"), F.lit(False))
    return x.select("id", F.when(base & (number(F.col("r.appendix")) == number(F.col("want_app"))), 2).when(base, 1).otherwise(0).alias("tier"))


_REVISION = "CASE o_orderkey % 6 WHEN 0 THEN 'V' WHEN 1 THEN 'S' WHEN 2 THEN NULL ELSE concat('0', o_orderkey % 5) END"


@query(f"""
WITH v AS (SELECT o_custkey AS kit, o_orderstatus = 'P' AS disk, CASE WHEN upper({_REVISION}) = 'V' THEN -2 WHEN upper({_REVISION}) = 'S' THEN -1 WHEN {_REVISION} IS NULL THEN -3 ELSE ({_REVISION})::INT END AS rank FROM orders),
 k AS (SELECT kit, max(rank) FILTER (NOT disk) AS official, max(rank) FILTER (disk) AS on_disk FROM v GROUP BY 1)
SELECT kit, official, CASE WHEN on_disk > coalesce(official, -9) THEN on_disk END AS working, CASE WHEN official IS NULL THEN 'only on disk' WHEN on_disk > official THEN 'ahead' WHEN on_disk IS NULL THEN 'not on disk' ELSE 'issued' END AS state FROM k
""")
def working_revisions(spark, d) -> DataFrame:
    """The highest issued revision of each kit, and the one on disk where it is ahead."""
    c = F.col
    v = table(spark, d, "orders").select(c("o_custkey").alias("kit"), (c("o_orderstatus") == "P").alias("disk"), keys.revision_rank(F.expr(_REVISION))["rev"].alias("rank"))
    k = v.groupBy("kit").agg(F.max(F.when(~c("disk"), c("rank"))).alias("official"), F.max(F.when(c("disk"), c("rank"))).alias("on_disk"))
    state = F.when(c("official").isNull(), "only on disk").when(c("on_disk") > c("official"), "ahead").when(c("on_disk").isNull(), "not on disk").otherwise("issued")
    return k.select("kit", "official", F.when(c("on_disk") > F.coalesce("official", F.lit(-9)), c("on_disk")).alias("working"), state.alias("state"))


@query("""
WITH s AS (SELECT o_custkey AS kit, max(o_orderdate)::DATE AS sent FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), o AS (SELECT kit, sent + 40 AS until FROM s WHERE kit % 5 = 0), n AS (SELECT max(o_orderdate)::DATE AS today FROM orders)
SELECT s.kit, date_diff('month', sent, today) AS months, CASE WHEN until >= today - 60 THEN 'confirmed' WHEN date_diff('month', sent, today) > 3 THEN 'late' WHEN date_diff('month', sent, today) > 0 THEN 'pending' ELSE 'current' END AS state FROM s LEFT JOIN o ON o.kit = s.kit, n
""")
def lateness_with_overrides(spark, d) -> DataFrame:
    """Months since the last open send, unless a review confirmed the kit for longer."""
    orders, c = table(spark, d, "orders"), F.col
    today = F.to_date(orders.agg(F.max("o_orderdate")).scalar())
    s = orders.filter("o_orderstatus = 'O'").groupBy(c("o_custkey").alias("kit")).agg(F.to_date(F.max("o_orderdate")).alias("sent"))
    until = s.filter("kit % 5 = 0").select("kit", F.date_add("sent", 40).alias("until"))
    months = ((F.year(today) - F.year("sent")) * 12 + F.month(today) - F.month("sent")).cast("long")
    state = F.when(c("until") >= F.date_sub(today, 60), "confirmed").when(c("months") > 3, "late").when(c("months") > 0, "pending").otherwise("current")
    return s.join(until, "kit", "left").withColumn("months", months).select("kit", "months", state.alias("state"))
