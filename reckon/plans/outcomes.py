"""Registered queries of allocation in phases, position statuses, overlays, unit gate, clusters and snapshot state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions import keys
from reckon.operators import allocate, clusters, match, overlay, position, units
from reckon.plans.registry import _sides, query
from reckon.sources.tables import table
from reckon.streaming import incremental

TAG = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('T', o_orderkey % 5) END"
_BOTH = f"""
 demand AS (SELECT o_orderkey AS demand_id, o_custkey AS c, {TAG} AS tag, o_orderdate AS t, floor(o_totalprice / 1000)::BIGINT AS q FROM orders WHERE o_orderstatus = 'O'),
 supply AS (SELECT o_orderkey AS supply_id, o_custkey AS c, {TAG} AS tag, o_orderdate AS t, floor(o_totalprice / 1000)::BIGINT AS q FROM orders WHERE o_orderstatus <> 'O')"""


def _tagged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Open orders are demand, all others supply."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), F.expr(TAG).alias("tag"), F.col("o_orderdate").alias("t"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("q"), "o_orderstatus")
    return o.filter("o_orderstatus = 'O'").drop("o_orderstatus").withColumnRenamed("o_orderkey", "demand_id"), o.filter("o_orderstatus <> 'O'").drop("o_orderstatus").withColumnRenamed("o_orderkey", "supply_id")


def _phase(i: int, on: str, supply_filter: str) -> str:
    done = " UNION ALL ".join(["SELECT NULL::BIGINT AS demand_id, NULL::BIGINT AS supply_id, 0::BIGINT AS n", *[f"SELECT demand_id, supply_id, n FROM g{j}" for j in range(i)]])
    left = lambda side: f"SELECT x.*, q - coalesce((SELECT sum(n) FROM ({done}) y WHERE y.{side}_id = x.{side}_id), 0) AS rest FROM {side} x"
    run = f"sum(rest) OVER (PARTITION BY {on} ORDER BY t, {{}}_id)"
    return f""",
 a{i} AS (SELECT * FROM ({left("demand")}) WHERE rest > 0), b{i} AS (SELECT * FROM ({left("supply")}) WHERE rest > 0 AND ({supply_filter.format(i=i)})),
 d{i} AS (SELECT *, {run.format("demand")} AS e FROM a{i}), s{i} AS (SELECT *, {run.format("supply")} AS e FROM b{i}),
 g{i} AS (SELECT demand_id, supply_id, (least(d.e, s.e) - greatest(d.e - d.rest, s.e - s.rest))::BIGINT AS n FROM d{i} d JOIN s{i} s USING ({on}) WHERE least(d.e, s.e) > greatest(d.e - d.rest, s.e - s.rest))"""


_ANY = "NOT EXISTS (SELECT 1 FROM a{i} w WHERE w.c = x.c AND w.tag = x.tag)"


@query(f"""
WITH {_BOTH}{_phase(0, "c, tag", "TRUE")}{_phase(1, "c", "tag IS NULL")}{_phase(2, "c", "TRUE").replace("rest > 0 AND (TRUE)", "rest > 0 AND NOT EXISTS (SELECT 1 FROM a2 w WHERE w.c = z.c AND w.tag = z.tag)").replace("b2 AS (SELECT * FROM (", "b2 AS (SELECT * FROM (").replace(") WHERE rest > 0 AND NOT", ") z WHERE rest > 0 AND NOT")}
SELECT demand_id, supply_id, n AS allocated, 'tag' AS phase FROM g0 UNION ALL SELECT demand_id, supply_id, n, 'untagged' FROM g1 UNION ALL SELECT demand_id, supply_id, n, 'any' FROM g2
""")
def allocate_in_phases(spark, d) -> DataFrame:
    """Delivery in global phases: by tag, from untagged supply, then from any that no sibling's open tag asks for."""
    demand, supply = _tagged(spark, d)
    phases = [("tag", ["c", "tag"], None), ("untagged", ["c"], F.col("tag").isNull()), ("any", ["c"], None)]
    return allocate.in_phases(demand, supply, phases, ["t", "demand_id"], ["t", "supply_id"], "q", reserve=("any",))


@query(f"""
WITH RECURSIVE {_BOTH}, need AS (SELECT c, demand_id, q, row_number() OVER (PARTITION BY c ORDER BY t, demand_id) AS r FROM demand), pool AS (SELECT c, sum(q)::BIGINT // 2 AS p FROM supply GROUP BY 1),
 walk(c, demand_id, q, r, taken, rest) AS (
  SELECT c, demand_id, q, r, CASE WHEN q > 0 AND q <= coalesce(p, 0) THEN q ELSE 0 END, coalesce(p, 0) - CASE WHEN q > 0 AND q <= coalesce(p, 0) THEN q ELSE 0 END FROM need LEFT JOIN pool USING (c) WHERE r = 1
  UNION ALL SELECT n.c, n.demand_id, n.q, n.r, CASE WHEN n.q > 0 AND n.q <= w.rest THEN n.q ELSE 0 END, w.rest - CASE WHEN n.q > 0 AND n.q <= w.rest THEN n.q ELSE 0 END FROM walk w JOIN need n ON n.c = w.c AND n.r = w.r + 1)
SELECT c, demand_id, q AS need, taken::BIGINT AS taken FROM walk
""")
def allocate_whole_or_nothing(spark, d) -> DataFrame:
    """The contract pre-pass: all a row needs or nothing; an unfit row doesn't block a smaller one after it."""
    demand, supply = _tagged(spark, d)
    pool = supply.groupBy("c").agg(F.floor(F.sum("q") / 2).cast("long").alias("p"))
    return allocate.whole_or_nothing(demand, pool, ["c"], ["t", "demand_id"], "q", "p")


@query(f"""
WITH RECURSIVE {_BOTH}, need AS (SELECT c, demand_id, t, q, row_number() OVER (PARTITION BY c ORDER BY t, demand_id) AS r FROM demand), pool AS (SELECT c, sum(q)::BIGINT AS p FROM supply GROUP BY 1),
 walk(c, demand_id, t, q, r, taken, rest) AS (
  SELECT c, demand_id, t, q, r, CASE WHEN q > 0 AND q <= coalesce(p, 0) THEN q ELSE 0 END, coalesce(p, 0) - CASE WHEN q > 0 AND q <= coalesce(p, 0) THEN q ELSE 0 END FROM need LEFT JOIN pool USING (c) WHERE r = 1
  UNION ALL SELECT n.c, n.demand_id, n.t, n.q, n.r, CASE WHEN n.q > 0 AND n.q <= w.rest THEN n.q ELSE 0 END, w.rest - CASE WHEN n.q > 0 AND n.q <= w.rest THEN n.q ELSE 0 END FROM walk w JOIN need n ON n.c = w.c AND n.r = w.r + 1),
 gone AS (SELECT c, sum(taken)::BIGINT AS g FROM walk GROUP BY 1), s AS (SELECT *, sum(q) OVER (PARTITION BY c ORDER BY tag IS NULL, q, supply_id) AS e FROM supply WHERE q > 0),
 d AS (SELECT c, demand_id, 'whole' AS phase, taken AS n, sum(taken) OVER (PARTITION BY c ORDER BY t, demand_id) AS e FROM walk WHERE taken > 0
  UNION ALL SELECT c, demand_id, 'partial', q, g + sum(q) OVER (PARTITION BY c ORDER BY t, demand_id) FROM walk JOIN gone USING (c) WHERE taken = 0 AND q > 0)
SELECT c, demand_id, supply_id, (least(d.e, s.e) - greatest(d.e - d.n, s.e - s.q))::BIGINT AS allocated, phase FROM d JOIN s USING (c) WHERE least(d.e, s.e) > greatest(d.e - d.n, s.e - s.q)
""")
def allocate_contract(spark, d) -> DataFrame:
    """Contract allocation: whole rows first, then partial fill; tagged supply before other, small before large."""
    demand, supply = _tagged(spark, d)
    supply = supply.withColumn("bare", F.col("tag").isNull())
    return allocate.contract(demand, supply, ["c"], ["t", "demand_id"], ["bare", "q", "supply_id"], "q")


@query(f"""
WITH {_BOTH}, need AS (SELECT c, sum(q)::BIGINT AS needed FROM demand WHERE tag IS NOT NULL GROUP BY 1),
 hit AS (SELECT c, sum(q)::BIGINT AS tagged FROM supply s WHERE EXISTS (SELECT 1 FROM demand d WHERE d.c = s.c AND d.tag = s.tag) GROUP BY 1), bare AS (SELECT c, sum(q)::BIGINT AS untagged FROM supply WHERE tag IS NULL GROUP BY 1)
SELECT c, needed, coalesce(tagged, 0) AS tagged, coalesce(untagged, 0) AS untagged, CASE WHEN coalesce(tagged, 0) + coalesce(untagged, 0) < needed THEN 'excluded' WHEN coalesce(tagged, 0) < needed AND coalesce(untagged, 0) > 0 THEN 'untagged' ELSE '' END AS status
FROM need LEFT JOIN hit USING (c) LEFT JOIN bare USING (c)
""")
def position_status(spark, d) -> DataFrame:
    """What supply, by tag and without, covers each group of tagged demand."""
    demand, supply = _tagged(spark, d)
    lists = lambda x: x.withColumn("tags", F.when(F.col("tag").isNull(), F.array().cast("array<string>")).otherwise(F.array("tag"))).drop("tag")
    return position.coverage(lists(demand), lists(supply), ["c"], "tags", "q")


@query("""
WITH d AS (SELECT o_orderkey demand_id, o_custkey c, o_orderpriority p, o_orderdate t FROM orders WHERE o_orderstatus = 'O'), s AS (SELECT o_orderkey supply_id, o_custkey c, o_orderpriority p, o_orderdate t FROM orders WHERE o_orderstatus = 'F'),
 m AS (SELECT demand_id, supply_id FROM (SELECT *, row_number() OVER (PARTITION BY c, p ORDER BY t, demand_id) r FROM d) JOIN (SELECT *, row_number() OVER (PARTITION BY c, p ORDER BY t, supply_id) r FROM s) USING (c, p, r))
SELECT demand_id, supply_id, CASE WHEN supply_id IS NULL THEN 'unmatched' ELSE 'tag and code' END AS pass FROM d LEFT JOIN m USING (demand_id)
UNION ALL SELECT NULL, supply_id, 'supply only' FROM s WHERE supply_id NOT IN (SELECT supply_id FROM m)
""")
def match_outcome(spark, d) -> DataFrame:
    """One-to-one match with what is left on both sides."""
    demand, supply = _sides(spark, d)
    pairs = match.passes(demand, supply, [("tag and code", [("o_custkey", "o_custkey"), ("o_orderpriority", "o_orderpriority")])], ["o_orderdate", "demand_id"], ["o_orderdate", "supply_id"])
    return match.outcome(demand, supply, pairs)


_VERSION = "CASE o_orderkey % 7 WHEN 0 THEN 'V' WHEN 1 THEN 'S' WHEN 2 THEN NULL WHEN 3 THEN 'x1' ELSE concat('0', o_orderkey % 4) END"


@query(f"""
WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderkey % 3 AS seq, o_orderstatus = 'P' AS skip, CASE WHEN upper({_VERSION}) = 'V' THEN -2 WHEN upper({_VERSION}) = 'S' THEN -1 WHEN regexp_matches({_VERSION}, '^[0-9]+$') THEN ({_VERSION})::INT ELSE -3 END AS rank, upper(coalesce({_VERSION}, '')) AS raw FROM orders),
 r AS (SELECT *, row_number() OVER w AS place, first_value(seq) OVER w AS ts, first_value(rank) OVER w AS tr, first_value(raw) OVER w AS traw FROM v WINDOW w AS (PARTITION BY o_custkey, skip ORDER BY seq DESC, rank DESC, raw DESC, o_orderdate DESC, o_orderkey DESC))
SELECT o_orderkey, CASE WHEN skip THEN 'ignored' WHEN place = 1 THEN 'current' WHEN seq = ts AND rank = tr AND raw = traw THEN 'ambiguous' ELSE 'superseded' END AS status,
  NOT skip AND place = 1 AND (SELECT max({{'a': x.rank, 'b': x.raw}}) FROM v x WHERE x.o_custkey = r.o_custkey AND NOT x.skip) > {{'a': rank, 'b': raw}} AS conflict FROM r
""")
def overlay_versions(spark, d) -> DataFrame:
    """Versions of each kit with ties, ignored paths and order conflicts."""
    o = table(spark, d, "orders").withColumn("seq", F.col("o_orderkey") % 3)
    rank = keys.revision_rank(F.expr(_VERSION))
    return overlay.overlay(o, ["o_custkey"], "seq", rank, "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "P").select("o_orderkey", "status", "conflict")


_UNIT, _DIM = "CASE WHEN l_partkey % 7 = 0 THEN 'kg' WHEN l_linenumber % 3 = 0 THEN 'kg' WHEN l_linenumber % 3 = 1 THEN 't' ELSE 'pc' END", "CASE p_partkey % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'pc' WHEN 2 THEN 'm' END"


@query(f"""
WITH r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS n, l_partkey AS code, {_UNIT} AS u, l_quantity::INT AS q FROM lineitem),
 dim AS (SELECT p_partkey AS code, {_DIM} AS d FROM part WHERE p_partkey % 6 < 3 UNION ALL SELECT p_partkey, 'other' FROM part WHERE p_partkey % 30 = 0),
 dd AS (SELECT code, min(d) AS d, count(DISTINCT d) AS nd FROM dim GROUP BY 1),
 m(u, c) AS (VALUES ('t', 0.5::DECIMAL(20,15)), ('pc', 3::DECIMAL(20,15)), ('kg', 1::DECIMAL(20,15))), seen AS (SELECT code, count(DISTINCT u) AS ns FROM r GROUP BY 1),
 x AS (SELECT r.code, u, q, c, coalesce(d, CASE WHEN r.code % 5 = 0 THEN 'kg' END) AS target, nd, ns, r.code % 10 = 3 AS clash FROM r LEFT JOIN dd USING (code) LEFT JOIN m USING (u) LEFT JOIN seen USING (code)),
 y AS (SELECT code, u AS source_unit, target AS target_unit, q, CASE WHEN code % 5 = 0 OR (clash AND u <> 'kg') THEN c END AS c, CASE WHEN nd > 1 THEN 'fatal: conflicting targets' WHEN target IS NULL AND ns > 1 THEN 'fatal: several units and no target' WHEN target IS NULL THEN 'kept' WHEN target = u THEN 'identity'
   WHEN clash AND u = 't' THEN 'fatal: conflicting coefficients' WHEN NOT (code % 5 = 0 OR (clash AND u <> 'kg')) THEN 'fatal: no coefficient' ELSE 'converted' END AS status FROM x)
SELECT code, source_unit, target_unit, status, count(*) AS n, sum(CASE WHEN status = 'converted' THEN q * c WHEN status IN ('identity', 'kept') THEN q END)::DECIMAL(38, 6) AS converted FROM y GROUP BY 1, 2, 3, 4
""")
def unit_gate(spark, d) -> DataFrame:
    """The unit gate over all requests: targets, coefficients and every kind of fatal, summed by code and unit."""
    lines = table(spark, d, "lineitem")
    requests = lines.select(F.monotonically_increasing_id().alias("request_id"), F.col("l_partkey").alias("code"), F.expr(_UNIT).alias("source_unit"), F.col("l_quantity").cast("int").cast("string").alias("quantity"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.expr(_DIM.replace("p_partkey", "p_partkey")).alias("unit"))
    dimension = part.filter("code % 6 < 3").unionAll(part.filter("code % 30 = 0").withColumn("unit", F.lit("other")))
    rows = F.array(*[F.struct(F.lit(u).alias("source_unit"), F.lit(c).alias("coefficient")) for u, c in (("t", "1/2"), ("pc", "3"), ("kg", "1"))])
    matrix = part.filter("code % 5 = 0 or code % 10 = 3").select("code", F.explode(rows).alias("m")).select("code", "m.*")
    matrix = matrix.filter("not (code % 10 = 3 and source_unit = 'kg' and code % 5 <> 0)").unionAll(part.filter("code % 10 = 3").select("code", F.lit("t").alias("source_unit"), F.lit("7").alias("coefficient")))
    planned = units.plan(requests, dimension, matrix)
    return planned.groupBy("code", "source_unit", "target_unit", "status").agg(F.count("*").alias("n"), F.sum("converted").cast("decimal(38,6)").alias("converted"))


@query("""
WITH RECURSIVE p AS (SELECT o_orderkey AS id, concat(o_custkey, o_orderpriority) AS v FROM orders UNION SELECT o_orderkey, concat('day ', o_orderdate::DATE) FROM orders WHERE o_orderkey % 20 = 0),
 e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b USING (v)), r(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1
""")
def connected_groups(spark, d) -> DataFrame:
    """Orders that are linked through a kit or, for some, a day."""
    o = table(spark, d, "orders")
    pairs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_custkey").cast("string"), "o_orderpriority").alias("v")).union(o.filter("o_orderkey % 20 = 0").select("o_orderkey", F.concat(F.lit("day "), F.to_date("o_orderdate").cast("string"))))
    return clusters.connected(pairs, "id", "v")


@query("""
WITH o AS (SELECT o_orderkey AS path, o_totalprice AS size, CASE WHEN o_orderkey % 9 = 2 THEN 'ignored' ELSE 'acknowledged' END AS review FROM orders WHERE o_orderkey % 4 <> 0),
 n AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 10 < 2 THEN o_totalprice + 1 ELSE o_totalprice END AS size FROM orders WHERE o_orderkey % 4 <> 1)
SELECT coalesce(o.path, n.path) AS path, coalesce(n.size, o.size) AS size, n.path IS NOT NULL AS present, CASE WHEN o.review = 'ignored' THEN 'ignored' WHEN o.path IS NULL OR (n.path IS NOT NULL AND n.size <> o.size) THEN 'pending' ELSE o.review END AS review
FROM o FULL JOIN n ON o.path = n.path
""")
def scan_upsert(spark, d) -> DataFrame:
    """The state after two reliable scans: baseline, then new, changed, missing and ignored paths."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"))
    first = incremental.upsert(None, o.filter("path % 4 <> 0"), "path", ["size"])
    first = first.withColumn("review", F.when(F.col("path") % 9 == 2, "ignored").otherwise(F.col("review")))
    second = o.filter("path % 4 <> 1").withColumn("size", F.when(F.col("path") % 10 < 2, F.col("size") + 1).otherwise(F.col("size")))
    return incremental.upsert(first, second, "path", ["size"])


ROW = {
    "vo": "CASE o_orderkey % 5 WHEN 0 THEN concat('T', o_custkey % 3) WHEN 1 THEN '' ELSE NULL END",
    "mto": "CASE o_orderkey % 4 WHEN 0 THEN concat('T', o_custkey % 2) WHEN 1 THEN '' ELSE NULL END",
    "first_tag": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE concat('T', o_custkey % 2) END",
    "code": "CASE o_orderkey % 6 WHEN 0 THEN '' ELSE concat('a', o_custkey % 3) END",
    "struck": "CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE concat(' A', o_custkey % 2) END",
    "place": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'S1/S2' ELSE concat('S', o_custkey % 3) END",
    "unit_a": "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'm' ELSE 'kg' END",
    "unit_b": "CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'm' ELSE 'kg' END",
    "qa": "o_orderkey % 7",
    "qb": "o_custkey % 7",
    "delivered": "CASE o_orderkey % 4 WHEN 0 THEN 0 ELSE o_custkey % 9 END",
}


@query(f"""
WITH x AS (SELECT o_orderkey AS id, {", ".join(f"{e} AS {n}" for n, e in ROW.items())}, o_orderstatus = 'O' AS a, o_orderstatus = 'F' OR o_orderkey % 3 = 0 AS b, o_orderkey % 2 = 0 AS excluded FROM orders)
SELECT id, CASE WHEN coalesce(vo, '') <> '' THEN vo WHEN coalesce(mto, '') <> '' THEN mto WHEN code <> '' OR excluded THEN coalesce(first_tag, '') ELSE '' END AS effective,
  CASE WHEN coalesce(vo, '') <> '' AND coalesce(mto, '') <> '' THEN CASE WHEN vo = mto THEN 'equal' ELSE 'different' END WHEN coalesce(vo, '') <> '' THEN 'left only' WHEN coalesce(mto, '') <> '' THEN 'right only' ELSE 'none' END AS pair,
  CASE WHEN code = '' OR struck IS NULL THEN '' WHEN upper(trim(code)) = upper(trim(struck)) THEN 'same' ELSE 'other' END AS struck,
  array_to_string(CASE WHEN place = '' THEN ['S1'] WHEN place = 'S1/S2' THEN ['S1', 'S2'] WHEN place = 'S1' THEN ['S1'] ELSE ['S1', place] END, '/') AS places,
  CASE WHEN unit_a <> '' AND unit_b IS NOT NULL THEN unit_a = unit_b END AS units, CASE WHEN unit_a <> '' AND unit_a = unit_b THEN qb - qa END AS diff,
  CASE WHEN qa = qb THEN 'match' WHEN qb < qa THEN 'increase' ELSE 'shortfall' END AS change,
  CASE WHEN coalesce(unit_a <> '' AND unit_b <> unit_a, false) THEN 'data problem' WHEN delivered = 0 THEN CASE WHEN a AND b THEN 'open' WHEN a THEN 'demand only' WHEN b THEN 'supply only' WHEN excluded THEN 'vendor only' ELSE 'demand only' END
   WHEN NOT a THEN 'delivery only' WHEN delivered < qa THEN 'short' WHEN delivered > qa THEN 'over' ELSE 'complete' END AS delivery FROM x
""")
def row_statuses(spark, d) -> DataFrame:
    """Statuses of one row: effective tag, tag pair, struck code, merged places, units, differences, delivery."""
    c = F.col
    x = table(spark, d, "orders").select(c("o_orderkey").alias("id"), *[F.expr(e).alias(n) for n, e in ROW.items()], (c("o_orderstatus") == "O").alias("a"), ((c("o_orderstatus") == "F") | (c("o_orderkey") % 3 == 0)).alias("b"), (c("o_orderkey") % 2 == 0).alias("excluded"))
    tags = F.when(c("first_tag").isNull(), F.array().cast("array<string>")).otherwise(F.array("first_tag"))
    agree = position.units_agree(c("unit_a"), c("unit_b"))
    return x.select(
        "id", position.effective_tag(c("vo"), c("mto"), tags, c("code") != "", c("excluded")).alias("effective"), position.pair_status(c("vo"), c("mto"), c("vo") == c("mto")).alias("pair"), position.struck_status(c("code"), c("struck")).alias("struck"),
        position.merged_places(F.lit("S1"), c("place")).alias("places"), agree.alias("units"), position.same_unit_difference(c("qa"), c("qb"), c("unit_a"), c("unit_b")).alias("diff"), position.difference_status(c("qb") - c("qa")).alias("change"),
        position.delivery_status(c("qa"), c("delivered"), c("a"), c("b"), c("excluded"), F.coalesce(~agree, F.lit(False))).alias("delivery"),
    )


_CODE, _NEW, _Q = "o_custkey % 700", "CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 700 + 1 END", "CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 20 = 1 THEN 0 ELSE floor(o_totalprice / 10000) END"


def _pass(i: int, name: str, on: str, done: str) -> str:
    """A ranked pass in SQL: ``on`` joins demand d and supply s."""
    d, s = (", ".join(side) for side in zip(*[x.split("=") for x in on.split(" and ")], strict=True))
    keys_ = [(a.strip(), b.strip()) for a, b in (x.split("=") for x in on.split(" and "))]
    real = " AND ".join(f"{a} IS NOT NULL" for a, _ in keys_), " AND ".join(f"{b} IS NOT NULL" for _, b in keys_)
    same = " AND ".join(f"x.{a} = y.{b}" for a, b in keys_)
    return f""",
 d{i} AS (SELECT *, row_number() OVER (PARTITION BY {d} ORDER BY t, demand_id) AS r FROM demand WHERE {real[0]} AND demand_id NOT IN (SELECT demand_id FROM {done})), s{i} AS (SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY t, supply_id) AS r FROM supply WHERE {real[1]} AND supply_id NOT IN (SELECT supply_id FROM {done})),
 m{i} AS (SELECT demand_id, supply_id, '{name}' AS pass FROM d{i} x JOIN s{i} y ON {same} AND x.r = y.r UNION ALL SELECT * FROM {done})"""


@query(f"""
WITH RECURSIVE demand AS (SELECT o_orderkey AS demand_id, {_CODE} AS code, {_NEW} AS new_code, {TAG} AS tag, o_orderdate AS t, ({_Q})::DOUBLE AS q FROM orders WHERE o_orderstatus = 'O'),
 supply AS (SELECT o_orderkey AS supply_id, {_CODE} AS code, {_NEW} AS new_code, {TAG} AS tag, o_orderdate AS t, ({_Q})::DOUBLE AS q FROM orders WHERE o_orderstatus <> 'O'), m AS (SELECT NULL::BIGINT AS demand_id, NULL::BIGINT AS supply_id, '' AS pass WHERE FALSE)
 {_pass(1, "tag and code", "tag=tag and code=code", "m")}{_pass(2, "tag and replacement", "tag=tag and new_code=code", "m1")}{_pass(3, "tag and reverse replacement", "tag=tag and code=new_code", "m2")},
 d4 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY t, demand_id) AS r FROM demand WHERE demand_id NOT IN (SELECT demand_id FROM m3)), s4 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY t, supply_id) AS r FROM supply WHERE supply_id NOT IN (SELECT supply_id FROM m3)),
 walk(code, r, place, demand_id, hit) AS (SELECT code, 0, 0, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT code FROM d4)
  UNION ALL SELECT w.code, w.r + 1, coalesce(n.k, w.place), d.demand_id, n.k FROM walk w JOIN d4 d ON d.code = w.code AND d.r = w.r + 1 LEFT JOIN LATERAL (SELECT min(s.r) AS k FROM s4 s WHERE s.code = w.code AND s.r > w.place AND (coalesce(d.q, 0) = 0 OR s.q <= d.q)) n ON TRUE),
 m4 AS (SELECT w.demand_id, s.supply_id, 'code' AS pass FROM walk w JOIN s4 s ON s.code = w.code AND s.r = w.hit UNION ALL SELECT * FROM m3),
 d5 AS (SELECT *, row_number() OVER (PARTITION BY new_code ORDER BY t, demand_id) AS r FROM demand WHERE new_code IS NOT NULL AND demand_id NOT IN (SELECT demand_id FROM m4)), s5 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY t, supply_id) AS r FROM supply WHERE supply_id NOT IN (SELECT supply_id FROM m4)),
 again(code, r, taken, demand_id, hit) AS (SELECT new_code, 0, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT new_code FROM d5)
  UNION ALL SELECT w.code, w.r + 1, CASE WHEN n.k IS NULL THEN w.taken ELSE list_append(w.taken, n.k) END, d.demand_id, n.k FROM again w JOIN d5 d ON d.new_code = w.code AND d.r = w.r + 1
   LEFT JOIN LATERAL (SELECT min(s.r) AS k FROM s5 s WHERE s.code = w.code AND NOT list_contains(w.taken, s.r) AND (coalesce(d.q, 0) = 0 OR s.q <= d.q)) n ON TRUE)
SELECT w.demand_id, s.supply_id, 'replacement' AS pass FROM again w JOIN s5 s ON s.code = w.code AND s.r = w.hit UNION ALL SELECT * FROM m4
""")
def match_consumable(spark, d) -> DataFrame:
    """All five passes of the one-to-one match: tags, replacements, and codes with the size guard."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_CODE).alias("code"), F.expr(_NEW).alias("new_code"), F.expr(TAG).alias("tag"), F.col("o_orderdate").alias("t"), F.expr(_Q).cast("double").alias("q"), "o_orderstatus")
    demand = o.filter("o_orderstatus = 'O'").drop("o_orderstatus").withColumnRenamed("o_orderkey", "demand_id")
    supply = o.filter("o_orderstatus <> 'O'").drop("o_orderstatus").withColumnRenamed("o_orderkey", "supply_id")
    return match.consume(demand, supply, ["t", "demand_id"], ["t", "supply_id"], "q")
