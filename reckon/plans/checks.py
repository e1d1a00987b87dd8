"""Registered queries of integrity checks, alignments, kits and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from reckon.operators import derived
from reckon.plans.registry import query
from reckon.sources.tables import table


def mask(columns: dict[str, int]) -> Column:
    """Presence mask: 0 must be empty, 1 must be filled, 3 either."""
    filled = {c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in columns}
    return reduce(Column.__and__, [filled[c] if m == 1 else ~filled[c] for c, m in columns.items() if m != 3], F.lit(True))


_CELLS = """o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('c', o_custkey) END AS code, CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE o_orderpriority END AS name,
 CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'pc' END AS unit, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(o_custkey % 50, ',5') ELSE concat(o_custkey % 50, '') END AS qty, CASE o_orderkey % 11 WHEN 0 THEN concat('1.', o_custkey % 9) ELSE '' END AS number"""
_HAS = "coalesce(trim({}) <> '', FALSE)"


@query(f"""
WITH x AS (SELECT {_CELLS} FROM orders), f AS (SELECT *, {", ".join(_HAS.format(c) + f" AS h_{c}" for c in ("code", "name", "unit", "qty", "number"))} FROM x)
SELECT id, CASE WHEN h_code AND h_name AND h_unit AND h_qty THEN 'position' WHEN NOT h_code AND h_name AND NOT h_unit AND NOT h_qty AND h_number THEN 'system' WHEN NOT h_code AND h_name AND NOT h_unit AND NOT h_qty THEN 'section'
  WHEN NOT h_code AND h_name AND h_unit THEN 'cabinet' WHEN NOT h_code AND NOT h_name AND NOT h_unit AND NOT h_qty AND NOT h_number THEN 'empty' ELSE 'other' END AS row_type,
  CASE WHEN NOT h_qty THEN 0 ELSE try_cast(replace(qty, ',', '.') AS DOUBLE) END AS value, coalesce(unit = 'pc' AND try_cast(replace(qty, ',', '.') AS DOUBLE) <> floor(try_cast(replace(qty, ',', '.') AS DOUBLE)), FALSE) AS fractional FROM f
""")
def masked_rows(spark, d) -> DataFrame:
    """Row types by ordered presence masks, coerced quantities, and pieces that aren't whole."""
    x = table(spark, d, "orders").selectExpr(*_CELLS_EXPRS)
    kind = (
        F.when(mask({"code": 1, "name": 1, "unit": 1, "qty": 1, "number": 3}), "position")
        .when(mask({"code": 0, "name": 1, "unit": 0, "qty": 0, "number": 1}), "system")
        .when(mask({"code": 0, "name": 1, "unit": 0, "qty": 0, "number": 3}), "section")
        .when(mask({"code": 0, "name": 1, "unit": 1, "qty": 3, "number": 3}), "cabinet")
        .when(mask({"code": 0, "name": 0, "unit": 0, "qty": 0, "number": 0}), "empty")
        .otherwise("other")
    )
    value = F.when(~mask({"qty": 1}), F.lit(0.0)).otherwise(F.replace("qty", F.lit(","), F.lit(".")).try_cast("double"))
    number = F.replace("qty", F.lit(","), F.lit(".")).try_cast("double")
    return x.select("id", kind.alias("row_type"), value.alias("value"), F.coalesce((F.col("unit") == "pc") & (number != F.floor(number)), F.lit(False)).alias("fractional"))



_CELLS_EXPRS = ["o_orderkey AS id"] + [f"{expr} AS {name}" for expr, name in zip(("CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('c', o_custkey) END", "CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE o_orderpriority END", "CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'pc' END", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(o_custkey % 50, ',5') ELSE concat(o_custkey % 50, '') END", "CASE o_orderkey % 11 WHEN 0 THEN concat('1.', o_custkey % 9) ELSE '' END"), ("code", "name", "unit", "qty", "number"), strict=True)]

_STATUS = "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Исключен' WHEN 2 THEN concat('заменен тег T', o_custkey % 9, ' на T', o_custkey % 7) WHEN 3 THEN NULL WHEN 4 THEN ' исключен ' ELSE 'что-то' END"
_CHANGE = r"^(?:заменен|замена) (?:тег|тега) (\S+) на (\S+)$"


@query(f"""
WITH x AS (SELECT o_orderkey AS id, lower(trim(coalesce({_STATUS}, ''))) AS s, trim(coalesce({_STATUS}, '')) AS raw FROM orders)
SELECT id, CASE WHEN s = '' THEN 'empty' WHEN s = 'исключен' THEN 'excluded' WHEN regexp_matches(s, '{_CHANGE}') THEN 'tag replaced' ELSE 'unknown' END AS kind, nullif(regexp_extract(raw, '{_CHANGE}', 1), '') AS old_tag, nullif(regexp_extract(raw, '{_CHANGE}', 2), '') AS new_tag FROM x
""")
def supply_statuses(spark, d) -> DataFrame:
    """Status cells: empty, excluded, a replaced tag with both names, or unknown."""
    raw = F.trim(F.coalesce(F.expr(_STATUS), F.lit("")))
    tag = lambda i: F.nullif(F.regexp_extract(raw, _CHANGE, i), F.lit(""))
    kind = F.when(raw == "", "empty").when(F.lower(raw) == "исключен", "excluded").when(F.lower(raw).rlike(_CHANGE), "tag replaced").otherwise("unknown")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), tag(1).alias("old_tag"), tag(2).alias("new_tag"))


_LOT = "SELECT o_orderkey AS id, o_custkey AS code, (floor(o_totalprice / 100) / 10)::DOUBLE AS lot, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['a' || (o_orderkey % 4)::VARCHAR, 'b' || (o_custkey % 5)::VARCHAR, 'c'] END AS tags FROM orders"


@query(f"""
WITH x AS ({_LOT}), u AS (SELECT id, code, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS i, lot FROM x)
SELECT id, code, tag, 1.0::DOUBLE AS qty, 'unit' AS kind FROM u WHERE i <= lot
UNION ALL SELECT id, code, NULL, least(floor(lot), 1e9) - least(len(tags), floor(lot)), 'units' FROM x WHERE floor(lot) > len(tags)
UNION ALL SELECT id, code, NULL, round(lot - floor(lot), 6), 'remainder' FROM x WHERE lot > floor(lot)
UNION ALL SELECT id, code, NULL, len(tags)::DOUBLE - floor(lot), 'more tags than quantity' FROM x WHERE len(tags) > floor(lot)
""")
def unit_queues(spark, d) -> DataFrame:
    """Quantities as unit items: the i-th tag to the i-th unit, further units as one counted row instead of single ones, the
    fraction as one untagged item; more tags than units is a finding."""
    o = table(spark, d, "orders")
    tags = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), (F.col("o_orderkey") % 4).cast("string")), F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string")), F.lit("c")))
    x = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("code"), (F.floor(F.col("o_totalprice") / 100) / 10).alias("lot"), tags.alias("tags")).withColumns({"whole": F.floor("lot").cast("double"), "n": F.size("tags").cast("double")})
    item = lambda tag, qty, kind, when: F.when(when, F.struct(tag.alias("tag"), qty.cast("double").alias("qty"), F.lit(kind).alias("kind")))
    none = F.lit(None).cast("string")
    units = F.transform("tags", lambda t, i: item(t, F.lit(1.0), "unit", i < F.col("whole")))
    rest = F.array(item(none, F.col("whole") - F.least("n", "whole"), "units", F.col("whole") > F.col("n")), item(none, F.round(F.col("lot") - F.col("whole"), 6), "remainder", F.col("lot") > F.col("whole")), item(none, F.col("n") - F.col("whole"), "more tags than quantity", F.col("n") > F.col("whole")))
    return x.select("id", "code", F.explode(F.array_compact(F.concat(units, rest))).alias("u")).select("id", "code", "u.*")


@query("""
WITH s AS (SELECT l_suppkey AS title, sum(l_quantity)::BIGINT AS input, sum(CASE WHEN l_linenumber < 7 OR l_suppkey % 3 = 0 THEN l_quantity ELSE 0 END)::BIGINT AS output, sum(CASE WHEN l_suppkey % 3 = 1 AND l_linenumber = 7 THEN l_quantity ELSE 0 END)::BIGINT AS untagged FROM lineitem GROUP BY 1)
SELECT title, input, output, untagged, CASE WHEN input = output THEN 'equal' WHEN input = output + untagged THEN 'equal with untagged' WHEN output < input THEN 'lost' ELSE 'inflated' END AS verdict FROM s
""")
def title_sums(spark, d) -> DataFrame:
    """Input and output sums of each title, with what came from untagged supply."""
    c, part = F.col, lambda w: F.sum(F.when(w, F.col("l_quantity")).otherwise(0)).cast("long")
    s = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("title")).agg(F.sum("l_quantity").cast("long").alias("input"), part((c("l_linenumber") < 7) | (c("l_suppkey") % 3 == 0)).alias("output"), part((c("l_suppkey") % 3 == 1) & (c("l_linenumber") == 7)).alias("untagged"))
    verdict = F.when(c("input") == c("output"), "equal").when(c("input") == c("output") + c("untagged"), "equal with untagged").when(c("output") < c("input"), "lost").otherwise("inflated")
    return s.withColumn("verdict", verdict)


_SOURCES = "CASE WHEN l_linenumber <= 2 THEN 'a' WHEN l_linenumber <= 4 THEN 'b' ELSE 'c' END"


@query(f"""
WITH s AS (SELECT l_orderkey AS code, {_SOURCES} AS src, sum(l_quantity)::BIGINT AS q, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1, 2),
 w AS (SELECT code, max(q) FILTER (src = 'a') AS a, max(q) FILTER (src = 'b') AS b, max(q) FILTER (src = 'c') AS c, count(*) AS n_sources, count(DISTINCT flags) AS n_flags, count(DISTINCT q) AS n_q FROM s GROUP BY 1)
SELECT code, a, b, c, n_sources, n_q > 1 AS quantity_differs, n_flags > 1 AS flags_differ FROM w
""")
def aligned_sources(spark, d) -> DataFrame:
    """Several sources side by side by code, each folded first, with a flag for each field that differs."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.expr(_SOURCES).alias("src")).agg(F.sum("l_quantity").cast("long").alias("q"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    side = lambda v: F.max(F.when(F.col("src") == v, F.col("q"))).alias(v)
    w = s.groupBy("code").agg(side("a"), side("b"), side("c"), F.count("*").alias("n_sources"), F.collect_set("q").alias("qs"), F.collect_set("flags").alias("fs"))  # one row a source
    return w.select("code", "a", "b", "c", "n_sources", (F.size("qs") > 1).alias("quantity_differs"), (F.size("fs") > 1).alias("flags_differ"))


@query("""
WITH demand AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_returnflag = 'N'), vendor AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08),
 rep AS (SELECT p_partkey AS code, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS new FROM part), tagged AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 AND l_discount > 0.05)
SELECT code FROM demand WHERE code NOT IN (SELECT code FROM vendor) AND code NOT IN (SELECT new FROM rep WHERE code IN (SELECT code FROM vendor) AND new IS NOT NULL) AND code NOT IN (SELECT code FROM tagged)
""")
def ban_list(spark, d) -> DataFrame:
    """Demand codes that neither vendors, nor the replacements of their codes, nor tagged supply know."""
    x = table(spark, d, "lineitem")
    codes = lambda w: x.filter(w).select(F.col("l_partkey").alias("code")).distinct()
    vendor = codes("l_returnflag = 'R' and l_discount > 0.08")
    rep = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.lead("p_partkey").over(W.partitionBy("p_brand", "p_type").orderBy("p_partkey")).alias("new"))
    replaced = rep.join(vendor, "code", "left_semi").filter("new is not null").select(F.col("new").alias("code"))
    known = vendor.union(replaced).union(codes("l_returnflag = 'A' and l_linenumber = 1 and l_discount > 0.05"))
    return codes("l_returnflag = 'N'").join(known, "code", "left_anti")


_KIT = """SELECT o_custkey % 400 AS kit, 'sheet' AS src, o_orderkey % 5 AS rev, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 400 < 300
 UNION ALL SELECT o_custkey % 400, 'send', o_orderkey % 4, o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 400 BETWEEN 51 AND 349 UNION ALL SELECT o_custkey % 400, 'disk', o_orderkey % 5, o_orderkey FROM orders WHERE o_custkey % 400 <> 7
 UNION ALL SELECT user_id % 400, 'robot', event_id % 5, event_id FROM events UNION ALL SELECT c_custkey % 400, 'mail', c_custkey % 5, c_custkey FROM customer WHERE c_custkey % 400 % 11 <> 0"""


@query(f"""
WITH k AS ({_KIT}), l AS (SELECT kit, max((rev, id)) FILTER (src = 'sheet') AS sheet, max((rev, id)) FILTER (src = 'send') AS send, max((rev, id)) FILTER (src = 'disk') AS disk, max((rev, id)) FILTER (src = 'robot') AS robot, max((rev, id)) FILTER (src = 'mail') AS mail FROM k GROUP BY 1),
 r AS (SELECT kit, sheet IS NOT NULL OR send IS NOT NULL AS expected, coalesce(sheet[1], send[1]) AS want, disk[1] AS disk, robot[1] AS robot, mail[1] AS mail FROM l)
SELECT kit, expected, want, disk, CASE WHEN expected AND disk IS NOT NULL AND disk <> want THEN 'revision differs' WHEN expected AND disk IS NULL THEN 'missing on disk' WHEN expected AND robot IS NULL THEN 'missing with robot' WHEN NOT expected AND disk IS NOT NULL THEN 'extra on disk' WHEN NOT expected AND robot IS NOT NULL THEN 'extra with robot'
  WHEN expected AND mail IS NULL THEN 'no letter' WHEN expected THEN 'aligned' ELSE 'mail only' END AS summary FROM r
""")
def kit_matrix(spark, d) -> DataFrame:
    """Union of the kits of five sources in one aggregation: what is expected, the newest revision of each, and the first
    flag by priority."""
    o, c = table(spark, d, "orders"), F.col
    of = lambda df, key, src, rev, num: df.select((c(key) % 400).alias("kit"), F.lit(src).alias("src"), rev.alias("rev"), c(num).alias("id"))
    k = c("o_custkey") % 400
    parts = [
        of(o.filter((c("o_orderkey") % 3 == 0) & (k < 300)), "o_custkey", "sheet", c("o_orderkey") % 5, "o_orderkey"), of(o.filter((c("o_orderkey") % 5 == 0) & k.between(51, 349)), "o_custkey", "send", c("o_orderkey") % 4, "o_orderkey"),
        of(o.filter(k != 7), "o_custkey", "disk", c("o_orderkey") % 5, "o_orderkey"), of(table(spark, d, "events"), "user_id", "robot", c("event_id") % 5, "event_id"),
        of(table(spark, d, "customer").filter("c_custkey % 400 % 11 <> 0"), "c_custkey", "mail", c("c_custkey") % 5, "c_custkey"),
    ]
    newest = lambda s: F.max(F.when(c("src") == s, F.struct("rev", "id")))["rev"].alias(s)
    r = reduce(DataFrame.unionAll, parts).groupBy("kit").agg(*[newest(s) for s in ("sheet", "send", "disk", "robot", "mail")])
    r = r.withColumns({"expected": c("sheet").isNotNull() | c("send").isNotNull(), "want": F.coalesce("sheet", "send")})
    e = c("expected")
    flags = [(e & (c("disk") != c("want")), "revision differs"), (e & c("disk").isNull(), "missing on disk"), (e & c("robot").isNull(), "missing with robot"), (~e & c("disk").isNotNull(), "extra on disk"), (~e & c("robot").isNotNull(), "extra with robot"), (e & c("mail").isNull(), "no letter"), (e, "aligned")]
    return r.select("kit", "expected", "want", "disk", F.coalesce(*[F.when(w, F.lit(n)) for w, n in flags], F.lit("mail only")).alias("summary"))


@query("""
WITH s AS (SELECT o_orderkey AS send, o_custkey AS kit, o_orderkey % 4 AS rev, o_orderdate AS t FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT o_custkey AS kit, o_orderkey % 4 AS rev, count(*) AS files, max(o_orderdate) AS newest, bool_or(o_orderstatus = 'P') AS as_built FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2),
 g AS (SELECT kit, rev FROM s ANTI JOIN p USING (kit, rev) GROUP BY 1, 2), last AS (SELECT kit, max((t, send))[2] AS last_send FROM s GROUP BY 1)
SELECT kit, rev, files, newest, as_built, FALSE AS grey, last_send FROM p LEFT JOIN last USING (kit) UNION ALL SELECT kit, rev, 0, NULL, FALSE, TRUE, last_send FROM g JOIN last USING (kit)
""")
def kit_packages(spark, d) -> DataFrame:
    """Packages of each kit and revision, grey ones for sends without a package, and the kit's latest send."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("send"), F.col("o_custkey").alias("kit"), (F.col("o_orderkey") % 4).alias("rev"), F.col("o_orderdate").alias("t"), "o_orderstatus")
    s, f = o.filter("send % 3 = 0"), o.filter("send % 3 <> 0")
    p = f.groupBy("kit", "rev").agg(F.count("*").alias("files"), F.max("t").alias("newest"), F.bool_or(F.col("o_orderstatus") == "P").alias("as_built")).withColumn("grey", F.lit(False))
    grey = s.select("kit", "rev").distinct().join(p, ["kit", "rev"], "left_anti").select("kit", "rev", F.lit(0).cast("long").alias("files"), F.lit(None).cast("timestamp_ntz" if dict(o.dtypes)["t"] == "timestamp_ntz" else "timestamp").alias("newest"), F.lit(False).alias("as_built"), F.lit(True).alias("grey"))
    last = s.groupBy("kit").agg(F.max(F.struct("t", "send"))["send"].alias("last_send"))
    return p.unionByName(grey).join(last, "kit", "left")


_DOC, _SIDE = "CASE WHEN o_orderkey % 97 = 1 THEN -o_custkey ELSE o_custkey END", "CASE WHEN o_orderkey % 97 = 1 THEN 1 WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 2 END"
_FILES = f"SELECT o_orderkey AS id, {_DOC} AS doc, {_SIDE} AS side FROM orders"


@query(f"""
WITH f AS ({_FILES}), c AS (SELECT doc, max(id) FILTER (side = 0) AS current, count(*) FILTER (side = 1) AS n, min(id) FILTER (side = 1) AS one FROM f GROUP BY 1)
SELECT doc, current, n AS n_counterparts, CASE WHEN n = 1 AND current IS NOT NULL THEN one END AS counterpart, CASE WHEN current IS NULL THEN 'extra' WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'pair' ELSE 'ambiguous' END AS status FROM c
""")
def paired_files(spark, d) -> DataFrame:
    """Current files with none, one or many counterparts, and counterparts that nothing asks for: one aggregation of both."""
    o, c = table(spark, d, "orders"), F.col
    f = o.select(c("o_orderkey").alias("id"), F.expr(_DOC).alias("doc"), F.expr(_SIDE).alias("side"))
    x = f.groupBy("doc").agg(F.max(F.when(c("side") == 0, c("id"))).alias("current"), F.count_if(c("side") == 1).alias("n_counterparts"), F.min(F.when(c("side") == 1, c("id"))).alias("one"))
    status = F.when(c("current").isNull(), "extra").when(c("n_counterparts") == 0, "none").when(c("n_counterparts") == 1, "pair").otherwise("ambiguous")
    return x.select("doc", "current", "n_counterparts", F.when(status == "pair", c("one")).alias("counterpart"), status.alias("status"))


@query("""
SELECT 'repeated id' AS issue, concat(o_custkey, o_orderpriority) AS key, count(*) AS n FROM orders GROUP BY 2 HAVING count(*) > 3
UNION ALL SELECT 'unknown customer', o_orderkey::VARCHAR, 1 FROM orders WHERE o_custkey + o_orderkey % 50 // 49 * 1000000 NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'conflicting attributes', o_custkey::VARCHAR, count(DISTINCT o_orderpriority) FROM orders GROUP BY 2 HAVING count(DISTINCT o_orderpriority) > 4
UNION ALL SELECT 'no order in work', c_custkey::VARCHAR, 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def registry_issues(spark, d) -> DataFrame:
    """Referential and uniqueness rules of a registry as one list of issues."""
    o, c, known = table(spark, d, "orders"), F.col, table(spark, d, "customer").select("c_custkey")
    text = lambda x: F.col(x).cast("string").alias("key")
    one = F.lit(1).cast("long").alias("n")
    found = [
        o.groupBy(F.concat(c("o_custkey").cast("string"), "o_orderpriority").alias("key")).agg(F.count("*").alias("n")).filter("n > 3").select(F.lit("repeated id").alias("issue"), "key", "n"),
        o.withColumn("ref", c("o_custkey") + F.floor(c("o_orderkey") % 50 / 49) * 1000000).join(known, c("ref") == c("c_custkey"), "left_anti").select(F.lit("unknown customer"), text("o_orderkey"), one),
        o.groupBy(text("o_custkey")).agg(F.countDistinct("o_orderpriority").alias("n")).filter("n > 4").select(F.lit("conflicting attributes"), "key", "n"),
        known.join(o.filter("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_anti").select(F.lit("no order in work"), text("c_custkey"), one),
    ]
    return reduce(DataFrame.unionAll, found)


@query("""
WITH d AS (SELECT p_partkey AS code, upper(p_brand) AS brand, p_size AS size FROM part WHERE p_partkey % 10 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n, CASE WHEN code IS NULL THEN 'unknown code' WHEN ('BRAND#' || (11 + l_suppkey % 5 * 10 + l_partkey % 5)) <> brand THEN CASE WHEN l_suppkey % 2 = 0 THEN 'corrected' ELSE 'differs' END ELSE 'equal' END AS verdict, size > 45 AS prohibited
FROM lineitem LEFT JOIN d ON l_partkey = code GROUP BY ALL
""")
def checked_by_code(spark, d) -> DataFrame:
    """Fields held against a dimension by code, corrected where the mode says so, with a list of prohibited codes."""
    c = F.col
    dim = table(spark, d, "part").filter("p_partkey % 10 <> 0").select(c("p_partkey").alias("code"), F.upper("p_brand").alias("brand"), c("p_size").alias("size"))
    own = F.concat(F.lit("BRAND#"), (F.lit(11) + c("l_suppkey") % 5 * 10 + c("l_partkey") % 5).cast("string"))
    verdict = F.when(c("code").isNull(), "unknown code").when(own != c("brand"), F.when(c("l_suppkey") % 2 == 0, "corrected").otherwise("differs")).otherwise("equal")
    x = table(spark, d, "lineitem").join(dim, c("l_partkey") == c("code"), "left")
    return x.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict"), (c("size") > 45).alias("prohibited")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT o_custkey AS kit, sha256(string_agg(o_orderstatus, '|' ORDER BY o_orderstatus, o_orderkey)) AS p FROM orders WHERE o_custkey % 17 <> 1 AND NOT (o_custkey % 10 = 0 AND o_orderkey % 4 = 0) GROUP BY 1), a AS (SELECT o_custkey AS kit, sha256(string_agg(o_orderstatus, '|' ORDER BY o_orderstatus, o_orderkey)) AS p FROM orders WHERE NOT (o_custkey % 19 = 2 AND o_custkey % 17 <> 1 AND o_custkey % 10 <> 0) GROUP BY 1)
SELECT coalesce(a.kit, b.kit) AS kit, CASE WHEN b.kit IS NULL THEN 'added' WHEN a.kit IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.kit = b.kit WHERE a.p IS DISTINCT FROM b.p
""")
def changed_keys(spark, d) -> DataFrame:
    """Keys whose rows differ between two snapshots; every order is in one of them."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("kit"), "o_orderstatus", "o_orderkey")
    before = o.filter("kit % 17 <> 1 and not (kit % 10 = 0 and o_orderkey % 4 = 0)").drop("o_orderkey")
    after = o.filter("not (kit % 19 = 2 and kit % 17 <> 1 and kit % 10 <> 0)").drop("o_orderkey")
    return derived.key_changes(before, after, "kit")


@query("""
WITH taken AS (SELECT o_custkey AS s, o_orderkey % 40 AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2), free AS (SELECT q.s, t.n, row_number() OVER (PARTITION BY q.s ORDER BY t.n) AS r FROM (SELECT DISTINCT o_custkey AS s FROM orders) q, range(0, 80) t(n) WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE x.s = q.s AND x.n = t.n)),
 need AS (SELECT o_orderkey AS id, o_custkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 3 <> 0)
SELECT id, need.s AS system, n AS number FROM need JOIN free USING (s, r)
""")
def free_numbers(spark, d) -> DataFrame:
    """Numbers for rows that have none, in order, past those already taken. The i-th free number is i plus the taken numbers
    before it: a running comparison of ranks, no list of all numbers."""
    o, c = table(spark, d, "orders"), F.col
    need = o.filter("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("id"), c("o_custkey").alias("system"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("free"))
    taken = o.filter("o_orderkey % 3 = 0").select(c("o_custkey").alias("system"), (c("o_orderkey") % 40).alias("n")).distinct()
    # the free numbers below a taken one: its value less the taken ones before it
    below = taken.withColumn("free", c("n") - F.row_number().over(W.partitionBy("system").orderBy("n")) + 1).select("system", "free", F.lit(None).cast("long").alias("id"), F.lit(0).alias("side"))
    both = below.unionByName(need.select("system", "free", "id", F.lit(1).alias("side")))
    passed = F.sum((c("side") == 0).cast("long")).over(W.partitionBy("system").orderBy("free", "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("number", c("free") + passed).filter("side = 1").select("id", "system", "number")


@query("""
WITH x AS (SELECT o_custkey AS cable, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'more' END AS kind, o_orderpriority AS laying, floor(o_totalprice / 1000)::BIGINT AS metres FROM orders),
 g AS (SELECT *, max(CASE WHEN kind = 'full' THEN n END) OVER (PARTITION BY cable ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM x)
SELECT cable, head, laying, sum(metres)::BIGINT AS metres, count(*) AS n_rows FROM g WHERE head IS NOT NULL GROUP BY 1, 2, 3
""")
def continuation_rows(spark, d) -> DataFrame:
    """Continuation rows folded into the full row before them, summed by laying type."""
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("cable"), F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("laying"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("metres"))
    head = F.last(F.when(F.col("n") % 3 == 0, F.col("n")), ignorenulls=True).over(W.partitionBy("cable").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow))
    return x.withColumn("head", head).filter("head is not null").groupBy("cable", "head", "laying").agg(F.sum("metres").alias("metres"), F.count("*").alias("n_rows"))


_PATH = "CASE page_id % 6 WHEN 0 THEN concat('/rd/1513/SOT/gate/0', page_id % 9, '_x/f.pdf') WHEN 1 THEN concat('/rd/SOT/0', page_id % 9, '_x/f.pdf') WHEN 2 THEN '/rd/1513/SOT/f.pdf' WHEN 3 THEN concat('/rd/1513/void_', page_id % 3, '/gate/01_/f.pdf') WHEN 4 THEN '/rd/1513/SOT/gate/f.pdf' ELSE '/rd/1513/SOT/gate/01_a/_OLD/f.pdf' END"
_REASONS = (("no title", "^/rd/[^0-9]"), ("skipped folder", "(?i)/(_old|void[^/]*)/"), ("no gate", "^/rd/[0-9]{4}/[^/]+/[^/]+$"), ("no package", "/gate/[^/]+$"))


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), r AS (SELECT page_id, CASE {" ".join(f"WHEN regexp_matches(path, '{p}') THEN '{n}'" for n, p in _REASONS)} END AS reason FROM p)
SELECT reason, count(*) AS n, array_to_string(list_sort(list(page_id))[1:3], ',') AS samples FROM r WHERE reason IS NOT NULL GROUP BY 1
""")
def layout_violations(spark, d) -> DataFrame:
    """Paths that break the folder layout by their first reason, counted, with three samples each."""
    p = table(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path"))
    reason = F.coalesce(*[F.when(F.col("path").rlike(q), F.lit(n)) for n, q in _REASONS])
    ranked = p.select("page_id", reason.alias("reason")).filter("reason is not null")
    first = ranked.withColumn("place", F.row_number().over(W.partitionBy("reason").orderBy("page_id"))).filter("place <= 3")  # each task keeps three
    samples = first.groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("page_id")).cast("array<string>"), ",").alias("samples"))
    return ranked.groupBy("reason").agg(F.count("*").alias("n")).join(samples, "reason")


@query("""
WITH x AS (SELECT o_custkey AS kit, o_orderkey AS doc, o_orderkey % 5 AS kind, sha256(concat(o_custkey, o_orderkey % 2)) AS print FROM orders WHERE o_orderkey % 3 <> 0), t AS (SELECT o_custkey AS kit, o_orderkey % 5 AS kind, max(sha256(concat(o_custkey, o_orderkey % 2))) AS print FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT kit, kind, doc, CASE WHEN t.print IS NULL THEN 'add' WHEN t.print = x.print THEN 'skip' ELSE 'replace' END AS action FROM x LEFT JOIN t USING (kit, kind)
""")
def export_plan(spark, d) -> DataFrame:
    """What an export adds, replaces or leaves alone, by fingerprints of what is there."""
    o, c = table(spark, d, "orders"), F.col
    print_ = lambda n: F.sha2(F.concat(c("o_custkey").cast("string"), (c("o_orderkey") % n).cast("string")), 256)
    x = o.filter("o_orderkey % 3 <> 0").select(c("o_custkey").alias("kit"), (c("o_orderkey") % 5).alias("kind"), c("o_orderkey").alias("doc"), print_(2).alias("own"))
    t = o.filter("o_orderkey % 3 = 0").groupBy(c("o_custkey").alias("kit"), (c("o_orderkey") % 5).alias("kind")).agg(F.max(print_(2)).alias("there"))
    return x.join(t, ["kit", "kind"], "left").select("kit", "kind", "doc", F.when(c("there").isNull(), "add").when(c("there") == c("own"), "skip").otherwise("replace").alias("action"))


@query("""
WITH e AS (SELECT user_id AS kit, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT * FROM e WHERE r = 1)
SELECT kit, count(*) AS n_lines, string_agg(strftime(ts, '%Y-%m-%d') || ' ' || event_type, ';' ORDER BY ts, event_id) AS log, max((ts, event_id))[2] AS last_event FROM k GROUP BY 1
""")
def dated_log(spark, d) -> DataFrame:
    """A dated log by kit: of entries with one identity (day and stage) the last replaces the others, in order of time."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("kit"), "event_type", F.to_date("ts").alias("day")).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    lines = F.array_sort(F.collect_list(F.struct("last.ts", "last.event_id", F.concat_ws(" ", F.date_format("last.ts", "yyyy-MM-dd"), "event_type").alias("line"))))
    x = e.groupBy("kit").agg(F.count("*").alias("n_lines"), lines.alias("l"))
    return x.select("kit", "n_lines", F.array_join(F.transform("l", lambda v: v["line"]), ";").alias("log"), F.element_at("l", -1)["event_id"].alias("last_event"))
