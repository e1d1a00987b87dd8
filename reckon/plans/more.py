"""Further registered queries: versions, texts, groups and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckon.functions import keys
from reckon.plans.registry import _lines, query
from reckon.sources.tables import table


@query("SELECT o_custkey, count(*) AS n, sha256(string_agg(v, '|' ORDER BY v)) AS print FROM (SELECT o_custkey, o_orderpriority || ':' || o_orderstatus AS v FROM orders) GROUP BY 1")
def multiset_fingerprint(spark, d) -> DataFrame:
    """A hash of a key's rows that doesn't hang on their order."""
    v = F.concat_ws(":", "o_orderpriority", "o_orderstatus")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(v)), "|"), 256).alias("print"))


@query("""
WITH s AS (SELECT l_partkey, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') AS a, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
SELECT l_partkey, len([x for x in coalesce(a, []) if NOT list_contains(coalesce(b, []), x)])::BIGINT AS only_left, len([x for x in coalesce(b, []) if NOT list_contains(coalesce(a, []), x)])::BIGINT AS only_right FROM s
""")
def tag_differences(spark, d) -> DataFrame:
    """Two-sided difference of tag sets."""
    tags = lambda v: F.collect_set(F.when(F.col("l_returnflag") == v, F.col("l_suppkey")))
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(tags("N").alias("a"), tags("R").alias("b"))
    return s.select("l_partkey", F.size(F.array_except("a", "b")).cast("long").alias("only_left"), F.size(F.array_except("b", "a")).cast("long").alias("only_right"))


@query("""
SELECT doc_id, i - 1 AS seq, length(lines[i]) AS chars FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE trim(lines[i]) <> ''
""")
def journal_lines(spark, d) -> DataFrame:
    """Lines of a cell as ordered events."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line")).filter(F.trim("line") != "")
    return x.select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("line").cast("long").alias("chars"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, regexp_extract(url, '://[^/]*/([a-z][a-z])/', 1) AS lang, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number, regexp_extract(url, '\.([a-z]+)(?:[?#]|$)', 1) AS extension FROM pages
""")
def parse_names(spark, d) -> DataFrame:
    """A name grammar as one projection."""
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, d, "pages").select("page_id", F.lower(part("^([a-z]+)://")).alias("scheme"), part("://[^/]*/([a-z][a-z])/").alias("lang"), part("/([0-9]+)").try_cast("long").alias("number"), part(r"\.([a-z]+)(?:[?#]|$)").alias("extension"))


@query("""
SELECT o_custkey, o_orderkey, score FROM (SELECT *, least(100, CASE WHEN o_orderstatus = 'F' THEN 60 ELSE 20 END + CASE WHEN o_orderpriority LIKE '1%' THEN 30 WHEN o_orderpriority LIKE '2%' THEN 20 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 20 ELSE 0 END) AS score FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderdate DESC, o_orderkey) = 1
""")
def best_candidate(spark, d) -> DataFrame:
    """Candidates by weighted points, held to 100, then by date; one winner a key, through an aggregate."""
    score = F.least(F.lit(100), F.when(F.col("o_orderstatus") == "F", 60).otherwise(20) + F.when(F.col("o_orderpriority").startswith("1"), 30).when(F.col("o_orderpriority").startswith("2"), 20).otherwise(0) + F.when(F.col("o_totalprice") > 200000, 20).otherwise(0))
    best = table(spark, d, "orders").withColumn("score", score).groupBy("o_custkey").agg(F.max(F.struct("score", "o_orderdate", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return best.select("o_custkey", (-F.col("b.k")).alias("o_orderkey"), F.col("b.score").alias("score"))


@query("""
WITH g AS (SELECT p_brand, l_partkey, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)::BIGINT AS a, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END)::BIGINT AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 v AS (SELECT p_brand, bool_and(abs(a - b) <= 800) AS same FROM g GROUP BY 1)
SELECT p_brand, same, sum(CASE WHEN same THEN a ELSE b END)::BIGINT AS qty, count(*) AS n_codes FROM g JOIN v USING (p_brand) GROUP BY 1, 2
""")
def hybrid_groups(spark, d) -> DataFrame:
    """All or nothing: a group takes one side only if every one of its keys agrees there, else the other side."""
    x = _lines(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda v: F.sum(F.when(F.col("l_linestatus") == v, F.col("qty")).otherwise(0))
    g = x.groupBy("p_brand", "l_partkey").agg(side("O").alias("a"), side("F").alias("b"))
    by = g.groupBy("p_brand").agg(F.bool_and(F.abs(F.col("a") - F.col("b")) <= 800).alias("same"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count("*").alias("n_codes"))
    return by.select("p_brand", "same", F.when(F.col("same"), F.col("sa")).otherwise(F.col("sb")).alias("qty"), "n_codes")


@query("""
WITH a AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
 b AS (SELECT l_suppkey, sha256(string_agg(l_partkey || ':' || q || ':' || n, ',' ORDER BY l_partkey)) AS exact, sha256(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey)) AS soft FROM a GROUP BY 1)
SELECT x.l_suppkey AS left_key, y.l_suppkey AS right_key, CASE WHEN x.exact = y.exact THEN 'exact' WHEN x.soft = y.soft THEN 'soft' ELSE 'different' END AS grade FROM b x JOIN b y ON y.l_suppkey = x.l_suppkey + 1
""")
def graded_equality(spark, d) -> DataFrame:
    """Neighbouring files compared as bags: equal with quantities, equal by code, or different."""
    a = _lines(spark, d).groupBy("l_suppkey", "l_partkey").agg(F.sum("qty").alias("q"), F.count("*").alias("n"))
    bag = F.array_sort(F.collect_list(F.struct("l_partkey", "q", "n")))
    b = a.groupBy("l_suppkey").agg(bag.alias("bag"))
    b = b.select("l_suppkey", F.sha2(F.to_json("bag"), 256).alias("exact"), F.sha2(F.to_json(F.transform("bag", lambda x: x["l_partkey"])), 256).alias("soft"))
    y = b.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("l_suppkey").alias("right_key"), F.col("exact").alias("e"), F.col("soft").alias("s"))
    grade = F.when(F.col("exact") == F.col("e"), "exact").when(F.col("soft") == F.col("s"), "soft").otherwise("different")
    return b.join(y, "l_suppkey").select(F.col("l_suppkey").alias("left_key"), "right_key", grade.alias("grade"))


@query("""
SELECT o_orderkey, (year(now_) - year(o_orderdate)) * 12 + month(now_) - month(o_orderdate) AS months_late FROM orders, (SELECT max(o_orderdate) AS now_ FROM orders) WHERE o_orderstatus = 'O' AND date_trunc('month', o_orderdate) < date_trunc('month', now_)
""")
def month_lateness(spark, d) -> DataFrame:
    """Open rows of months before the last one, in whole months."""
    o = table(spark, d, "orders")
    now = o.agg(F.max("o_orderdate")).scalar()
    months = (F.year(now) - F.year("o_orderdate")) * 12 + F.month(now) - F.month("o_orderdate")
    return o.filter((F.col("o_orderstatus") == "O") & (F.date_trunc("month", "o_orderdate") < F.date_trunc("month", now))).select("o_orderkey", months.cast("long").alias("months_late"))


@query("""
WITH k AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber <= 3 THEN l_linenumber END AS place, l_returnflag, sum(l_quantity)::BIGINT AS qty, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT * FROM k WHERE n > 1 OR place IS NULL
""")
def collapse_rows(spark, d) -> DataFrame:
    """Two families of keys in one aggregation: with a position number and without."""
    place = F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber"))
    k = _lines(spark, d).groupBy("l_orderkey", "l_partkey", place.alias("place"), "l_returnflag").agg(F.sum("qty").alias("qty"), F.count("*").alias("n"))
    return k.filter("n > 1 or place is null")


_NUMBER = "CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '.', p_partkey, '00000') WHEN 1 THEN concat('-0', p_size, ',0') WHEN 2 THEN '-0,000' WHEN 3 THEN concat(p_size, ' 000.123456789012345', p_size) ELSE concat(p_size, ' pc') END"


@query(f"""
WITH x AS (SELECT p_partkey, {_NUMBER} AS t FROM part), y AS (SELECT *, replace(replace(t, ' ', ''), ',', '.') AS n FROM x)
SELECT p_partkey, CASE WHEN NOT regexp_matches(n, '^-?[0-9.]+$') THEN t WHEN n::DECIMAL(38, 20) = 0 THEN '0' ELSE regexp_replace(regexp_replace(n::DECIMAL(38, 20)::VARCHAR, '0+$', ''), '[.]$', '') END AS number FROM y
""")
def canonical_numbers(spark, d) -> DataFrame:
    """Numbers as text with all their digits, without an exponent or trailing zeros."""
    return table(spark, d, "part").select("p_partkey", keys.number(F.expr(_NUMBER)).alias("number"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_matrix(spark, d) -> DataFrame:
    """Key by status, with known statuses so that no pass is needed to find them."""
    out = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return out.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("""
WITH old AS (SELECT l_partkey AS code, sum(l_quantity)::BIGINT AS q, min(l_suppkey) AS s FROM lineitem GROUP BY 1), new AS (SELECT l_partkey + 1 AS code, sum(l_quantity)::BIGINT AS q, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
 a AS (SELECT q, s, min(code) AS c FROM old GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT q, s, min(code) AS c FROM new GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.c AS old_code, b.c AS new_code FROM a JOIN b USING (q, s) WHERE a.c <> b.c
""")
def renamed_codes(spark, d) -> DataFrame:
    """Rows equal but for the code, with a single partner on either side."""
    base = _lines(spark, d).groupBy("l_partkey").agg(F.sum("qty").alias("q"), F.min("l_suppkey").alias("s"))
    single = lambda c, n: base.groupBy("q", "s").agg(F.min(c).alias(n), F.count("*").alias("n")).filter("n = 1").drop("n")
    return single(F.col("l_partkey"), "old_code").join(single(F.col("l_partkey") + 1, "new_code"), ["q", "s"]).filter("old_code <> new_code").select("old_code", "new_code")


@query("""
SELECT user_id, event_id, CASE WHEN s <= 100 THEN v ELSE greatest(v - (s - 100), 0) END AS taken FROM (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, floor(value)::BIGINT AS v FROM events))
""")
def consume_terms(spark, d) -> DataFrame:
    """Terms used up in order until the sum is reached."""
    v = table(spark, d, "events").withColumn("v", F.floor("value").cast("long"))
    s = F.sum("v").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    v = v.withColumn("s", s)
    return v.select("user_id", "event_id", F.when(F.col("s") <= 100, F.col("v")).otherwise(F.greatest(F.col("v") - (F.col("s") - 100), F.lit(0).cast("long"))).alias("taken"))


@query("""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2
""")
def hourly_counts(spark, d) -> DataFrame:
    """Tumbling windows; the streaming form is in ``reckon.streaming``."""
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
