"""All queries of the reconciliation engine by name, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckon.functions import keys
from reckon.operators import allocate, diff, expand, match, overlay, reconcile
from reckon.sources.tables import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _lines(spark, d):
    return table(spark, d, "lineitem").withColumn("qty", F.col("l_quantity").cast("long"))


@query("""
WITH l AS (SELECT l_partkey, sum(l_quantity)::BIGINT q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
     r AS (SELECT l_partkey, sum(l_quantity)::BIGINT q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(l.l_partkey, r.l_partkey) AS l_partkey, l.q AS left_qty, r.q AS right_qty, coalesce(l.q, 0) - coalesce(r.q, 0) AS diff,
  CASE WHEN l.q IS NULL THEN 'right only' WHEN r.q IS NULL THEN 'left only' WHEN l.q = r.q THEN 'equal' WHEN l.q < r.q THEN 'over' ELSE 'short' END AS status
FROM l FULL JOIN r ON l.l_partkey = r.l_partkey
""")
def grouped_reconcile(spark, d) -> DataFrame:
    """Demand (flag N) against supply (flag R) by code: sums, difference, status. Flag A, what is neither, takes no part."""
    x = _lines(spark, d)
    return reconcile.two_sides(x.filter("l_returnflag = 'N'"), x.filter("l_returnflag = 'R'"), ["l_partkey"], "qty")


@query("""
SELECT l_partkey, sum(l_quantity)::BIGINT AS qty, count(*) AS n_rows, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers
FROM lineitem GROUP BY l_partkey
""")
def unique_rows_by_code(spark, d) -> DataFrame:
    """Rows of one code folded: summed quantity, the distinct sources in order."""
    return _lines(spark, d).groupBy("l_partkey").agg(F.sum("qty").alias("qty"), F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d) -> DataFrame:
    return reconcile.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH s AS (SELECT p_brand, sum(l_quantity)::BIGINT AS qty_in, sum(CASE WHEN l_discount < 0.09 THEN l_quantity ELSE 0 END)::BIGINT AS qty_out,
    sum(CASE WHEN l_linenumber > 6 THEN l_quantity ELSE 0 END)::BIGINT AS tolerance
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, qty_in, qty_out, tolerance, CASE WHEN abs(qty_in - qty_out) <= 0.01 THEN 'ok' WHEN abs(qty_in - qty_out) <= tolerance THEN 'warn' ELSE 'error' END AS verdict FROM s
""")
def conservation_check(spark, d) -> DataFrame:
    """Quantity in against quantity out for each partition, in tolerance tiers."""
    x = _lines(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    part = lambda c: F.sum(F.when(c, F.col("qty")).otherwise(0))
    out = x.groupBy("p_brand").agg(F.sum("qty").alias("qty_in"), part(F.col("l_discount") < 0.09).alias("qty_out"), part(F.col("l_linenumber") > 6).alias("tolerance"))
    return out.withColumn("verdict", reconcile.verdict(F.col("qty_in") - F.col("qty_out"), F.col("tolerance")))


@query("""
WITH g AS (SELECT l_partkey,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0)::BIGINT AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0)::BIGINT AS n, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0)::BIGINT AS r,
    min(l_linestatus) FILTER (l_returnflag = 'A') AS ua, min(l_linestatus) FILTER (l_returnflag = 'R') AS ur
  FROM lineitem GROUP BY 1)
SELECT l_partkey, a, n, r, CASE WHEN a <> 0 AND r <> 0 AND ua IS DISTINCT FROM ur THEN NULL ELSE a - r END AS diff_a_r FROM g
""")
def pivot_accumulation(spark, d) -> DataFrame:
    """Code by source, with a difference only where both sides have one unit."""
    flag = lambda v, c, f: f(F.when(F.col("l_returnflag") == v, F.col(c)))
    g = _lines(spark, d).groupBy("l_partkey").agg(*[F.coalesce(flag(v, "qty", F.sum), F.lit(0)).alias(v.lower()) for v in "ANR"], flag("A", "l_linestatus", F.min).alias("ua"), flag("R", "l_linestatus", F.min).alias("ur"))
    clash = (F.col("a") != 0) & (F.col("r") != 0) & ~F.col("ua").eqNullSafe(F.col("ur"))
    return g.select("l_partkey", "a", "n", "r", F.when(~clash, F.col("a") - F.col("r")).alias("diff_a_r"))


_PRESENCE = """
  SELECT k, bool_or(s = 1) AS in_customer, bool_or(s = 2) AS in_orders, bool_or(s = 3) AS in_events, bool_or(s = 4) AS in_labels
  FROM (SELECT c_custkey k, 1 s FROM customer UNION ALL SELECT o_custkey, 2 FROM orders UNION ALL SELECT user_id, 3 FROM events UNION ALL SELECT doc_id, 4 FROM labels) GROUP BY k
"""


@query(_PRESENCE)
def presence_matrix(spark, d) -> DataFrame:
    """Union of the keys of four sources, with a flag for each."""
    of = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return reconcile.presence({"customer": of("customer", "c_custkey"), "orders": of("orders", "o_custkey"), "events": of("events", "user_id"), "labels": of("labels", "doc_id")}, "k")


@query(f"SELECT (in_customer::INT + in_orders::INT + in_events::INT + in_labels::INT)::BIGINT AS n_sources, count(*) AS n_keys FROM ({_PRESENCE}) GROUP BY 1")
def coverage_kpi(spark, d) -> DataFrame:
    flags = [F.col(f"in_{s}").cast("long") for s in ("customer", "orders", "events", "labels")]
    return presence_matrix(spark, d).groupBy(reduce(lambda a, b: a + b, flags).alias("n_sources")).agg(F.count("*").alias("n_keys"))


_DIFF = "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_orderkey END"


@query(f"""
WITH c AS (SELECT {_DIFF} AS code, l_suppkey, l_quantity, l_returnflag, l_linenumber, sum((l_linestatus = 'O')::INT) nl, sum((l_linestatus = 'F')::INT) nr FROM lineitem GROUP BY ALL),
 r AS (SELECT * EXCLUDE (nl, nr), greatest(nl - nr, 0)::BIGINT AS n_removed, greatest(nr - nl, 0)::BIGINT AS n_added FROM c WHERE nl <> nr),
 ch AS (SELECT code FROM r WHERE code IS NOT NULL GROUP BY code HAVING sum(n_removed) = 1 AND sum(n_added) = 1), m AS (SELECT *, coalesce(code IN (SELECT code FROM ch), FALSE) AS changed FROM r),
 rn AS (SELECT l_suppkey, l_quantity, l_returnflag, l_linenumber, TRUE AS renamed FROM m WHERE NOT changed GROUP BY 1, 2, 3, 4 HAVING sum(n_removed) = 1 AND sum(n_added) = 1)
SELECT m.* EXCLUDE (changed), CASE WHEN changed THEN 'changed' WHEN renamed THEN 'renamed' WHEN n_added = 0 THEN 'removed' ELSE 'added' END AS kind FROM m LEFT JOIN rn USING (l_suppkey, l_quantity, l_returnflag, l_linenumber)
""")
def multiset_diff(spark, d) -> DataFrame:
    """Two tables as multisets: changed, renamed, removed and added rows."""
    x = table(spark, d, "lineitem").withColumn("code", F.expr(_DIFF))
    return diff.multiset_diff(x.filter("l_linestatus = 'O'"), x.filter("l_linestatus = 'F'"), "code", ["l_suppkey", "l_quantity", "l_returnflag", "l_linenumber"])


def _sides(spark, d):
    o = table(spark, d, "orders")
    part = lambda s, n: o.filter(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias(n), "o_custkey", "o_orderpriority", "o_orderdate", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("amount"))
    return part("O", "demand_id"), part("F", "supply_id")


@query("""
WITH d AS (SELECT o_orderkey demand_id, o_custkey c, o_orderpriority p, o_orderdate t FROM orders WHERE o_orderstatus = 'O'),
 s AS (SELECT o_orderkey supply_id, o_custkey c, o_orderpriority p, o_orderdate t FROM orders WHERE o_orderstatus = 'F'),
 d1 AS (SELECT *, row_number() OVER (PARTITION BY c, p ORDER BY t, demand_id) r FROM d), s1 AS (SELECT *, row_number() OVER (PARTITION BY c, p ORDER BY t, supply_id) r FROM s),
 m1 AS (SELECT demand_id, supply_id FROM d1 JOIN s1 USING (c, p, r)),
 d2 AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, demand_id) r FROM d WHERE demand_id NOT IN (SELECT demand_id FROM m1)),
 s2 AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, supply_id) r FROM s WHERE supply_id NOT IN (SELECT supply_id FROM m1))
SELECT demand_id, supply_id, 'tag and code' AS pass FROM m1 UNION ALL SELECT demand_id, supply_id, 'code' FROM d2 JOIN s2 USING (c, r)
""")
def match_passes(spark, d) -> DataFrame:
    """One-to-one match of open with finished orders in two passes, in order of the date; orders in work take no part."""
    demand, supply = _sides(spark, d)
    plan = [("tag and code", [("o_custkey", "o_custkey"), ("o_orderpriority", "o_orderpriority")]), ("code", [("o_custkey", "o_custkey")])]
    return match.passes(demand, supply, plan, ["o_orderdate", "demand_id"], ["o_orderdate", "supply_id"])


@query("""
WITH d AS (SELECT o_custkey, o_orderkey demand_id, floor(o_totalprice / 1000)::BIGINT q, sum(floor(o_totalprice / 1000)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) e FROM orders WHERE o_orderstatus = 'O'),
 s AS (SELECT o_custkey, o_orderkey supply_id, floor(o_totalprice / 1000)::BIGINT q, sum(floor(o_totalprice / 1000)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) e FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, demand_id, supply_id, (least(d.e, s.e) - greatest(d.e - d.q, s.e - s.q))::BIGINT AS allocated FROM d JOIN s USING (o_custkey) WHERE greatest(d.e - d.q, s.e - s.q) < least(d.e, s.e)
""")
def allocate_fifo(spark, d) -> DataFrame:
    """Open orders served by finished ones, first come, first served; orders in work take no part."""
    demand, supply = _sides(spark, d)
    return allocate.fifo(demand, supply, ["o_custkey"], ["o_orderdate", "demand_id"], ["o_orderdate", "supply_id"], "amount", "amount")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ignored'
  WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'current' ELSE 'superseded' END AS status FROM orders
""")
def overlay_newest_wins(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return overlay.newest_wins(o, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderstatus") == "P").select("o_orderkey", "status")


_LATEST = "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders {} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@query(_LATEST.format(""))
def latest_per_key(spark, d) -> DataFrame:
    return overlay.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])


@query(_LATEST.format("WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:00'"))
def overlay_as_of(spark, d) -> DataFrame:
    """The versions that were current on a day."""
    return overlay.latest(table(spark, d, "orders").filter("o_orderdate <= timestamp'1996-01-01 00:00:00'"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])


@query("""
SELECT o_orderkey, o_totalprice, highest_before FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM orders) WHERE o_totalprice < highest_before
""")
def order_conflicts(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return overlay.order_conflicts(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice")).select("o_orderkey", "o_totalprice", "highest_before")


@query("""
SELECT * FROM (SELECT o_custkey, o_orderkey AS older, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS newer FROM orders) WHERE newer IS NOT NULL
""")
def adjacent_pairs(spark, d) -> DataFrame:
    """Each version with the next one."""
    newer = F.lead("o_orderkey").over(W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("older"), newer.alias("newer")).filter("newer is not null")


@query("""
WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_type, ' ') ELSE [] END AS tags, p_brand = 'Brand#11' AS no_unit, p_size % 7 = 0 AS no_code FROM part)
SELECT p_partkey, u.tag AS unit_tag, u.qty AS unit_qty FROM (SELECT p_partkey, unnest(CASE
  WHEN NOT no_unit AND len(tags) > 1 THEN [{'tag': tags[i], 'qty': CASE WHEN i <= p_size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END} for i in range(1, len(tags) + 1)]
  WHEN NOT no_unit AND NOT no_code AND len(tags) = 0 AND p_size > 1 THEN [{'tag': NULL::VARCHAR, 'qty': 1.0::DOUBLE} for i in range(1, p_size + 1)]
  ELSE [{'tag': tags[1], 'qty': p_size::DOUBLE}] END) AS u FROM p)
""")
def explode_units(spark, d) -> DataFrame:
    """Demand rows as units, by tag or by quantity."""
    p = table(spark, d, "part").withColumn("tags", F.when(F.col("p_partkey") % 2 == 0, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")))
    return expand.demand_units(p, "p_size", "tags", F.col("p_brand") == "Brand#11", F.col("p_size") % 7 == 0).select("p_partkey", "unit_tag", "unit_qty")


@query("""
SELECT event_id, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events
""")
def fill_sections(spark, d) -> DataFrame:
    """Every row under its last heading."""
    return expand.fill_forward(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("value") > 50, F.col("event_id")), "section").select("event_id", "section")


@query("""
SELECT p_partkey, CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'empty' WHEN p_size <= 2 THEN 'head' WHEN regexp_matches(p_type, '^(STANDARD|PROMO)') AND p_size > 40 THEN 'section' WHEN p_retailprice IS NOT NULL AND p_size > 0 THEN 'position' ELSE 'other' END AS row_type FROM part
""")
def classify_rows(spark, d) -> DataFrame:
    """Row types by an ordered chain of masks."""
    kind = F.when(F.col("p_name").isNull() | (F.trim("p_name") == ""), "empty").when(F.col("p_size") <= 2, "head").when(F.col("p_type").rlike("^(STANDARD|PROMO)") & (F.col("p_size") > 40), "section").when(F.col("p_retailprice").isNotNull() & (F.col("p_size") > 0), "position").otherwise("other")
    return table(spark, d, "part").select("p_partkey", kind.alias("row_type"))


_REVISION = "CASE p_partkey % 6 WHEN 0 THEN 'V' WHEN 1 THEN ' s ' WHEN 2 THEN concat(p_size, '') WHEN 3 THEN 'B2' WHEN 4 THEN '' ELSE NULL END"


@query(rf"""
SELECT p_partkey, nullif(upper(regexp_replace(p_name, '\s+', '', 'g')), '') AS code, nullif(trim(regexp_replace(p_type, '\s+', ' ', 'g')), '') AS text,
  nullif(regexp_replace(trim(p_brand || '..'), '\.+$', ''), '') AS unit, try_cast(replace(replace(p_size::VARCHAR || CASE WHEN p_partkey % 5 = 0 THEN ' x' ELSE ',5' END, ' ', ''), ',', '.') AS DECIMAL(38,6)) AS quantity,
  CASE WHEN upper(trim({_REVISION})) = 'V' THEN -2 WHEN upper(trim({_REVISION})) = 'S' THEN -1 WHEN regexp_matches(trim({_REVISION}), '^[0-9]+$') THEN trim({_REVISION})::INT ELSE -3 END AS revision
FROM part
""")
def normalise_keys(spark, d) -> DataFrame:
    """Scalar normalisers of codes, texts, units, quantities and revisions."""
    amount = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, " x").otherwise(",5"))
    return table(spark, d, "part").select("p_partkey", keys.code(F.col("p_name")).alias("code"), keys.text(F.col("p_type")).alias("text"), keys.unit(F.concat("p_brand", F.lit(".."))).alias("unit"), keys.quantity(amount).alias("quantity"), keys.revision_rank(F.expr(_REVISION))["rev"].alias("revision"))


@query("""
WITH m(unit, coefficient) AS (VALUES (0, 1.0), (1, 0.5), (2, 12.0), (3, NULL))
SELECT l_orderkey, l_linenumber, p_partkey, l_suppkey, l_quantity * coalesce(coefficient, 1) AS converted, CASE WHEN coefficient IS NULL THEN 'kept' WHEN coefficient = 1 THEN 'identity' ELSE 'converted' END AS status
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN m ON p_size % 4 = unit
""")
def convert_units(spark, d) -> DataFrame:
    """Quantities in target units; identical units keep theirs, unknown targets are kept and named."""
    matrix = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 12.0), (3, None)], "unit int, coefficient double")
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("unit")), F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(matrix), "unit")  # four rows
    status = F.when(F.col("coefficient").isNull(), "kept").when(F.col("coefficient") == 1, "identity").otherwise("converted")
    return x.select("l_orderkey", "l_linenumber", "p_partkey", "l_suppkey", (F.col("l_quantity") * F.coalesce("coefficient", F.lit(1.0))).alias("converted"), status.alias("status"))


@query("""
SELECT o_orderkey, min(CASE WHEN event_id % 100 = o_orderkey % 100 THEN 1 WHEN abs(date_diff('day', (DATE '2024-01-01' + (o_orderkey % 365)::INT), ts::DATE)) <= 2 THEN 2 END) AS reason
FROM orders JOIN events ON o_custkey = user_id GROUP BY 1 HAVING reason IS NOT NULL
""")
def match_events(spark, d) -> DataFrame:
    """The strongest reason that links a send with any of its events: number first, then a date within two days. Each reason
    is an equality: dates are spread over the five days around them, so no key meets all its events."""
    sends = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 365).cast("int")).alias("sent"))
    events = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"), (F.col("event_id") % 100).alias("number"), F.to_date("ts").alias("day"))
    by_number = sends.withColumn("number", F.col("o_orderkey") % 100).join(events.select("o_custkey", "number").distinct(), ["o_custkey", "number"]).select("o_orderkey", F.lit(1).alias("reason"))
    near = sends.withColumn("day", F.explode(F.sequence(F.date_sub("sent", 2), F.date_add("sent", 2))))
    by_day = near.join(events.select("o_custkey", "day").distinct(), ["o_custkey", "day"]).select("o_orderkey", F.lit(2).alias("reason"))
    return by_number.unionAll(by_day).groupBy("o_orderkey").agg(F.min("reason").alias("reason"))


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice p FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END p FROM orders WHERE o_orderkey % 4 <> 1)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o.p IS DISTINCT FROM n.p THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey
""")
def snapshot_upsert(spark, d) -> DataFrame:
    """Two snapshots compared: what is new, changed, missing or the same."""
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_totalprice").alias("p"))
    new = o.filter("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("n"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("np"))
    state = F.when(F.col("o_orderkey").isNull(), "new").when(F.col("n").isNull(), "missing").when(~F.col("p").eqNullSafe(F.col("np")), "changed").otherwise("same")
    return old.join(new, F.col("o_orderkey") == F.col("n"), "full").select(F.coalesce("o_orderkey", "n").alias("o_orderkey"), state.alias("state"))


RULES = {1000: r"\?", 1001: r"//[^/]*(bets|casino)", 1002: r"/[0-9]+\.html", 1003: r"#"}


@query("\nUNION ALL\n".join(f"SELECT page_id, {n} AS rule FROM pages WHERE regexp_matches(url, '{p}')" for n, p in RULES.items()))
def rule_findings(spark, d) -> DataFrame:
    """Findings of declarative predicates, all in one scan."""
    hits = F.array_compact(F.array(*[F.when(F.col("url").rlike(p), F.lit(n)) for n, p in RULES.items()]))
    return table(spark, d, "pages").select("page_id", F.explode(hits).alias("rule"))


@query("""
SELECT user_id, count(*) AS n_events, CASE WHEN bool_or(event_type = 'purchase' AND value > 90) THEN 'agreed' WHEN bool_or(event_type = 'purchase') THEN 'review' WHEN bool_or(event_type = 'click') THEN 'sent' ELSE 'not uploaded' END AS status FROM events GROUP BY 1
""")
def status_machine(spark, d) -> DataFrame:
    """A key's status by the strongest of its events."""
    has = lambda c: F.bool_or(c)
    bought = F.col("event_type") == "purchase"
    out = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), has(bought & (F.col("value") > 90)).alias("a"), has(bought).alias("b"), has(F.col("event_type") == "click").alias("c"))
    return out.select("user_id", "n_events", F.when(F.col("a"), "agreed").when(F.col("b"), "review").when(F.col("c"), "sent").otherwise("not uploaded").alias("status"))


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count("*").alias("n"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) WHERE abs(step) > 1")
def numbering_gaps(spark, d) -> DataFrame:
    step = F.col("o_orderkey") - F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", step.alias("step")).filter("abs(step) > 1")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphan_rows(spark, d) -> DataFrame:
    """Customers without an order that is pending."""
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def status_totals(spark, d) -> DataFrame:
    """Counts with subtotals and a grand total."""
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT p_partkey AS old_code, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS new_code FROM part)
SELECT l_orderkey, l_partkey, coalesce(new_code, l_partkey) AS code, new_code IS NOT NULL AS replaced, sum(l_quantity)::BIGINT AS qty FROM lineitem LEFT JOIN r ON l_partkey = old_code GROUP BY ALL
""")
def replace_codes(spark, d) -> DataFrame:
    """Demand under its replacement codes."""
    new = F.lead("p_partkey").over(W.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    r = table(spark, d, "part").select(F.col("p_partkey").alias("old_code"), new.alias("new_code"))
    x = _lines(spark, d).join(r, F.col("l_partkey") == F.col("old_code"), "left")
    return x.groupBy("l_orderkey", "l_partkey", F.coalesce("new_code", "l_partkey").alias("code"), F.col("new_code").isNotNull().alias("replaced")).agg(F.sum("qty").alias("qty"))


@query("""
SELECT sha256(o_custkey::VARCHAR || chr(31) || o_orderstatus) AS identity, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY 1
""")
def fingerprint_identity(spark, d) -> DataFrame:
    """Rows found again after a reload by an identity hash."""
    return table(spark, d, "orders").groupBy(keys.fingerprint(F.col("o_custkey"), F.col("o_orderstatus")).alias("identity")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))
