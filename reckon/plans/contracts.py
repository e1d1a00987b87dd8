"""Registered queries of contract labels and of the unit matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import aliases, unit_matrix
from reckon.plans.registry import query
from reckon.sources import sinks
from reckon.sources.tables import table
from reckon.sources.work import Work

_NUMBER = "(l_suppkey % 60)::VARCHAR"
_LABEL = """CASE l_linenumber % 7 WHEN 0 THEN concat('DS', {n}) WHEN 1 THEN concat('ds 0', {n}) WHEN 2 THEN concat({n}, '/', l_partkey % 4) WHEN 3 THEN concat('DS', {n}, 'b') WHEN 4 THEN concat('DS00', {n}, '_', lower(l_returnflag)) WHEN 5 THEN concat('DS', {n}, '_') ELSE ' ' END"""
_ENTRIES = """SELECT s_suppkey AS entry_id, CASE s_suppkey % 4 WHEN 0 THEN concat('DS', s_suppkey % 60) WHEN 1 THEN concat('DS0', s_suppkey % 60, 'A') WHEN 2 THEN concat(s_suppkey % 60, '/', s_suppkey % 3) ELSE concat('DS', s_suppkey % 60, '_', s_name) END AS label,
  CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE concat('m', s_nationkey % 5) END AS manager FROM supplier WHERE s_suppkey % 60 < 50"""
_ROWS = f"SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS ask_id, {_LABEL.format(n=_NUMBER)} AS name, CASE WHEN l_quantity < 10 THEN NULL ELSE concat('DS', l_orderkey % 70) END AS actual FROM lineitem"
_ALIASES = r"""list_distinct([k, regexp_replace(k, '^(DS)0+([0-9].*)$', '\1\2'), regexp_replace(k, '^(DS[0-9]+(?:_[0-9]+)?)[A-ZА-ЯЁ]+$', '\1'), regexp_replace(regexp_replace(k, '^(DS)0+([0-9].*)$', '\1\2'), '^(DS[0-9]+(?:_[0-9]+)?)[A-ZА-ЯЁ]+$', '\1'),
  regexp_replace(k, '^(DS[0-9]+)(?:_[^0-9].*|_+)$', '\1'), regexp_replace(regexp_replace(k, '^(DS)0+([0-9].*)$', '\1\2'), '^(DS[0-9]+)(?:_[^0-9].*|_+)$', '\1')])"""


def _key(label: str) -> str:
    return f"(SELECT CASE WHEN s = '' THEN NULL WHEN regexp_matches(s, '^[0-9]') THEN concat('DS', s) ELSE s END FROM (SELECT replace(replace(upper(trim({label})), ' ', ''), '/', '_') AS s))"


_INDEX = f"""
 e AS ({_ENTRIES}), ea AS (SELECT DISTINCT entry_id, trim(manager) AS manager, alias FROM (SELECT entry_id, manager, unnest(v) AS alias FROM (SELECT *, {_ALIASES} AS v FROM (SELECT *, {_key("label")} AS k FROM e)))),
 i AS (SELECT alias, min(entry_id) AS entry_id, min(m) < max(m) AS ambiguous FROM (SELECT ea.alias, ea.entry_id, e.manager AS m FROM ea JOIN e USING (entry_id)) GROUP BY 1)"""


@query(f"WITH {_INDEX} SELECT alias, entry_id, ambiguous FROM i")
def contract_aliases(spark, d) -> DataFrame:
    """Every way to write a supplier's contract, with the first entry that has it."""
    return aliases.alias_index(_entries(spark, d).withColumnRenamed("manager", "value"), "DS")


def _entries(spark, d) -> DataFrame:
    table(spark, d, "supplier").createOrReplaceTempView("contract_suppliers")
    return spark.sql(_ENTRIES.replace("FROM supplier", "FROM contract_suppliers"))


def _rows(spark, d) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("contract_lines")
    return spark.sql(_ROWS.replace("FROM lineitem", "FROM contract_lines").replace("::VARCHAR", "").replace("::BIGINT", "").replace("round(l_extendedprice * 100)", "CAST(round(l_extendedprice * 100) AS BIGINT)"))


@query(f"""
WITH {_INDEX}, r AS (SELECT ask_id, nullif(trim(name), '') AS name, nullif(trim(actual), '') AS actual FROM ({_ROWS})),
 q AS (SELECT ask_id, name, actual, NULL AS part FROM r WHERE name IS NULL OR NOT contains(name, '/') UNION ALL SELECT ask_id, name, actual, unnest(string_split(name, '/')) FROM r WHERE contains(name, '/')),
 a AS (SELECT ask_id, part, 0 AS which, {_key("coalesce(part, name)")} AS k FROM q UNION ALL SELECT ask_id, part, 1, {_key("actual")} FROM q WHERE part IS NULL),
 v AS (SELECT ask_id, part, which, k, regexp_replace(k, '^(DS)0+([0-9].*)$', '\\1\\2') AS z FROM a WHERE k IS NOT NULL),
 w AS (SELECT ask_id, part, which, unnest([k, z, regexp_replace(k, '^(DS[0-9]+(?:_[0-9]+)?)[A-ZА-ЯЁ]+$', '\\1'), regexp_replace(z, '^(DS[0-9]+(?:_[0-9]+)?)[A-ZА-ЯЁ]+$', '\\1'), regexp_replace(k, '^(DS[0-9]+)(?:_[^0-9].*|_+)$', '\\1'), regexp_replace(z, '^(DS[0-9]+)(?:_[^0-9].*|_+)$', '\\1')]) AS alias, unnest(range(6)) AS t FROM v),
 h AS (SELECT ask_id, part, arg_min(i.entry_id, which * 6 + t) AS entry_id, arg_min(i.ambiguous, which * 6 + t) AS ambiguous FROM w JOIN i USING (alias) GROUP BY ALL),
 n AS (SELECT h.*, nullif(trim(e.manager), '') AS manager FROM h JOIN e USING (entry_id)),
 one AS (SELECT r.ask_id, coalesce(name, actual) AS label, manager, CASE WHEN name IS NULL AND actual IS NULL THEN '' WHEN entry_id IS NULL THEN 'not listed' WHEN manager IS NULL THEN 'no manager' WHEN ambiguous THEN 'ambiguous' ELSE '' END AS note FROM r LEFT JOIN n ON n.ask_id = r.ask_id AND n.part IS NULL WHERE name IS NULL OR NOT contains(name, '/')),
 several AS (SELECT q.ask_id, concat('DS', any_value(name)) AS label, min(manager) AS lo, max(manager) AS hi, count(manager) = count(*) AS every_ FROM q LEFT JOIN n ON n.ask_id = q.ask_id AND n.part = q.part WHERE q.part IS NOT NULL GROUP BY 1)
SELECT * FROM one UNION ALL SELECT ask_id, label, CASE WHEN every_ AND lo = hi THEN lo END, CASE WHEN every_ AND lo = hi THEN '' ELSE 'mixed' END FROM several
""")
def contract_managers(spark, d) -> DataFrame:
    """The manager of each line's contract, by whatever alias it is written with."""
    work = Work(spark)
    return work.finished(aliases.with_managers(_rows(spark, d), _entries(spark, d), work, "DS"))


#: The stored matrix, the dimension and the observed units, from parts and their lines.
_MATRIX = """
 c0 AS (SELECT p_partkey AS code, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'kg' ELSE 'pc' END AS target, CASE WHEN p_partkey % 10 = 0 THEN 'collision' ELSE '' END AS status FROM part WHERE p_size > 10),
 p0 AS (SELECT code, unit, CASE WHEN k = 1 THEN 1 WHEN code % 7 = 0 THEN NULL ELSE 12 END::DECIMAL(18, 4) AS coefficient, k = 0 AND code % 7 = 0 AS open FROM (SELECT code, coalesce(target, 'pc') AS unit, 1 AS k FROM c0 UNION ALL SELECT code, 'box', 0 FROM c0 WHERE code % 3 = 0)),
 t0 AS (SELECT p_partkey AS code, CASE WHEN p_partkey % 6 = 0 THEN 'm' ELSE 'pc' END AS target FROM part WHERE p_brand < 'Brand#2'),
 o0 AS (SELECT DISTINCT l_partkey AS code, CASE WHEN l_quantity > 30 THEN 'pc' WHEN l_quantity > 12 THEN 'box' ELSE concat('u', l_linenumber % 3) END AS unit FROM lineitem WHERE l_tax > 0.03 AND l_discount > 0.06)"""


def _matrix(spark, d) -> tuple[DataFrame, ...]:
    c = F.col
    part = table(spark, d, "part")
    codes = part.filter("p_size > 10").select(c("p_partkey").alias("code"), F.when(c("p_partkey") % 5 == 0, None).when(c("p_partkey") % 5 == 1, "kg").otherwise("pc").alias("target"), F.when(c("p_partkey") % 10 == 0, unit_matrix.COLLISION).otherwise("").alias("status"))
    seven = c("code") % 7 == 0
    pairs = codes.select("code", F.coalesce("target", F.lit("pc")).alias("unit"), F.lit(1).cast("decimal(18,4)").alias("coefficient"), F.lit(False).alias("open"))
    pairs = pairs.union(codes.filter("code % 3 = 0").select("code", F.lit("box"), F.when(~seven, F.lit(12)).cast("decimal(18,4)"), seven))
    targets = part.filter("p_brand < 'Brand#2'").select(c("p_partkey").alias("code"), F.when(c("p_partkey") % 6 == 0, "m").otherwise("pc").alias("target"))
    unit = F.when(c("l_quantity") > 30, "pc").when(c("l_quantity") > 12, "box").otherwise(F.concat(F.lit("u"), (c("l_linenumber") % 3).cast("string")))
    return codes, pairs, targets, table(spark, d, "lineitem").filter("l_tax > 0.03 and l_discount > 0.06").select(c("l_partkey").alias("code"), unit.alias("unit"))


_MERGED = f"""{_MATRIX},
 h AS (SELECT coalesce(c0.code, n.code) AS code, coalesce(t0.target, c0.target) AS target, coalesce(c0.target, '') <> coalesce(t0.target, c0.target, '') OR (t0.target IS NULL AND coalesce(status, '') = 'collision') AS changed, coalesce(units, 0) AS units, coalesce(status, '') AS was
   FROM c0 FULL JOIN (SELECT code, count(*) AS units FROM o0 GROUP BY 1) n ON n.code = c0.code LEFT JOIN t0 ON t0.code = coalesce(c0.code, n.code)),
 u AS (SELECT code, unit FROM p0 UNION SELECT code, unit FROM o0 UNION SELECT code, target FROM h WHERE target IS NOT NULL),
 m AS (SELECT u.code, u.unit, CASE WHEN u.unit = target OR (target IS NULL AND o0.unit IS NOT NULL AND (units = 1 OR p0.unit IS NULL)) THEN 'one' WHEN target IS NOT NULL AND changed THEN 'open' WHEN p0.unit IS NULL THEN 'open' WHEN target IS NOT NULL AND o0.unit IS NOT NULL AND p0.coefficient IS NULL THEN 'open' ELSE 'kept' END AS how, p0.coefficient AS c, p0.open AS o
   FROM u JOIN h USING (code) LEFT JOIN p0 ON p0.code = u.code AND p0.unit = u.unit LEFT JOIN o0 ON o0.code = u.code AND o0.unit = u.unit),
 n AS (SELECT code, unit, CASE how WHEN 'one' THEN 1 WHEN 'kept' THEN c END::DECIMAL(18, 4) AS coefficient, CASE how WHEN 'one' THEN FALSE WHEN 'open' THEN TRUE ELSE o END AS open FROM m)"""


@query(f"WITH {_MERGED} SELECT code, unit, coefficient, open FROM n")
def unit_matrix_pairs(spark, d) -> DataFrame:
    """Pairs of the merged matrix."""
    work = Work(spark)
    return work.finished(unit_matrix.reconcile(*_matrix(spark, d), work)[1])


@query(f"""
WITH {_MERGED}, x AS (SELECT code, target, CASE WHEN target IS NOT NULL THEN CASE WHEN code IN (SELECT code FROM n WHERE open) THEN 'needs a coefficient' ELSE '' END WHEN units > 1 THEN 'collision' WHEN units = 1 THEN 'no target' ELSE was END AS status FROM h)
SELECT code, target, status, 1 AS version FROM x
""")
def unit_matrix_versions(spark, d) -> DataFrame:
    """Codes of the merged matrix, stored as a version; a second run on the result is equal, so it adds none."""
    work = Work(spark)
    codes, pairs, targets, observed = _matrix(spark, d)
    first = unit_matrix.reconcile(codes, pairs, targets, observed, work)
    path = f"{work.base}/matrix"
    version = unit_matrix.write_if_changed(first[0], path, 1, None)
    again = unit_matrix.reconcile(*first, targets, observed, work)
    version = unit_matrix.write_if_changed(again[0], path, 2, version)
    return work.finished(sinks.read_version(spark, path, version).withColumn("version", F.lit(version)))
