"""The row types of all sheet layouts as one registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators import layouts
from reckon.plans.registry import query
from reckon.sources.tables import table

_KEY = "(o_orderkey * 7 + o_custkey)"
#: Cells that are filled or not in many combinations; some hold a heading's words.
CELLS = {c: f"CASE WHEN {_KEY} % {m} < {k} THEN '{v}' WHEN {_KEY} % {m} = {k} THEN NULL ELSE concat('x', o_custkey) END" for c, m, k, v in (
    ("tags", 4, 2, ""), ("numbers", 3, 1, ""), ("name", 5, 1, " "), ("type_mark", 7, 3, ""), ("vendor", 6, 3, ""), ("mass", 4, 3, ""), ("title", 5, 1, ""), ("specification", 7, 1, ""), ("ds_name", 9, 1, ""), ("ds_number", 8, 1, ""),
    ("system", 3, 1, ""), ("work_code", 4, 1, ""), ("work_name", 5, 2, ""), ("annotation", 90, 1, "Примечание"), ("code_1c", 60, 1, "Код 1С СОУ"),
)}
CELLS |= {"vendor": f"CASE WHEN {_KEY} % 80 = 5 THEN 'Поставщик' WHEN {_KEY} % 6 < 3 THEN '' ELSE 'v' END", "code": f"CASE WHEN {_KEY} % 40 = 0 THEN 'Код РД' WHEN {_KEY} % 2 = 0 THEN '' ELSE 'c' END", "units": f"CASE WHEN {_KEY} % 50 = 1 THEN 'Ед. изм.' WHEN {_KEY} % 50 = 2 THEN 'Единица измерения' WHEN {_KEY} % 3 = 0 THEN '' ELSE 'pc' END", "values": f"CASE WHEN {_KEY} % 70 = 3 THEN 'Кол-во' WHEN {_KEY} % 3 = 0 THEN NULL ELSE '1' END"}
#: A tenth of the rows has hardly any cell, so that rows of all types occur.
SPARSE = {"empty": set(), "system": {"tags"}, "section": {"numbers", "name", "work_name"}, "cabinet": {"numbers", "name", "type_mark"}}


def _cell(name: str) -> str:
    cases = " ".join(f"WHEN {_KEY} % 20 = {i} THEN {chr(39) + 'x' + chr(39) if name in full else chr(39) * 2}" for i, full in enumerate(SPARSE.values()))
    return f"CASE {cases} ELSE {CELLS[name]} END"


def _sql(layout: layouts.Layout) -> str:
    full = lambda c: f"trim(coalesce({c}, '')) <> ''"
    head = " OR ".join(f"coalesce(contains({c}, '{w}'), FALSE)" for c, words in layout.heads.items() for w in words) or "FALSE"
    rules = " ".join(f"WHEN {' AND '.join([full(c) for c in a.split()] + [f'NOT ({full(c)})' for c in b.split()]) or 'TRUE'} THEN '{n}'" for n, a, b in layout.rules)
    return f"CASE WHEN {head} THEN '{layout.head}' {rules} ELSE '{layout.otherwise}' END"


@query(f"""
WITH x AS (SELECT o_orderkey AS id, {", ".join(f'{_cell(c)} AS "{c}"' for c in CELLS)} FROM orders)
SELECT id, {", ".join(f"{_sql(x)} AS {n}" for n, x in layouts.LAYOUTS.items()).replace("coalesce(values,", 'coalesce("values",').replace("contains(values,", 'contains("values",')},
  CASE WHEN {_sql(layouts.LAYOUTS["supply"]).replace("coalesce(values,", 'coalesce("values",')} = 'system' THEN tags ELSE name END AS shown_name FROM x
""")
def row_layouts(spark, d) -> DataFrame:
    """Each row's type in every layout, and the name that a system row takes from its tags."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[F.expr(_cell(c)).alias(c) for c in CELLS])
    types = {n: layouts.row_type(lay) for n, lay in layouts.LAYOUTS.items()}
    return x.select("id", *[t.alias(n) for n, t in types.items()], layouts.system_name(types["supply"])["name"].alias("shown_name"))
