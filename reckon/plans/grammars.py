"""Registered queries of the grammars and scalar normalisers. Their texts are made from table columns so that every branch
occurs; the same expressions, which both engines read alike, give the texts to the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions import grammar as G
from reckon.functions import keys
from reckon.plans.registry import query
from reckon.sources.tables import table

NAME = """CASE o_orderkey % 9
 WHEN 0 THEN concat('ABCD.', lpad(concat(o_custkey % 1000, ''), 3, '0'), '-2879-SOT.OD-', lpad(concat(o_orderkey % 10000, ''), 4, '0'), '_0', o_custkey % 5, '-AN0', o_custkey % 4, '_RU.doc')
 WHEN 1 THEN concat('xx ABCD.287–', 1000 + o_custkey % 9000, '-KSB', o_custkey % 10, '.MTO-0001.', o_orderkey % 30, '_V_EN.xlsx')
 WHEN 2 THEN concat('ABCD.2871-7417-SKUD.1.OD.', o_orderkey % 20, '.pdf')
 WHEN 3 THEN concat('ABCD.287-2879-ПТ.OD-12', o_custkey % 10, '.pdf_S_ER.pdf')
 WHEN 4 THEN concat('ABCD.28-2879-SOT.OD-0001_01_RU.doc')
 WHEN 5 THEN concat('WXYZ.999-0001-SOT1.AB1-0007_', o_custkey % 30, '_EN.dwg')
 WHEN 6 THEN concat('ABCD.287-2879-SOT.OD-0001_0', o_custkey % 5, '-AN0', o_custkey % 4, '-RU.doc')
 WHEN 7 THEN '' ELSE o_orderpriority END"""

_S = G.STRICT % "[A-Z]{4}"
_L = G.LOOSE % "[A-Z]{4}"


def _dash(x: str) -> str:
    return f"translate({x}, '{G.DASHES}', '{'-' * len(G.DASHES)}')"


def _p(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def _groups(x: str, pattern: str, **names: int) -> str:
    return ", ".join(f"{_p(x, pattern, i)} AS {n}" for n, i in names.items())


@query(f"""
SELECT id, {_groups("x", _S, contract=1, title_system=2, discipline=3, sheet=4)}, {_groups(_p("x", _S, 5), G.TAIL_PARTS, revision=1, appendix=2, language=3, file_type=4)}, regexp_matches(x, '{_S}') AS strict
FROM (SELECT o_orderkey AS id, {_dash(NAME)} AS x FROM orders)
""")
def document_names(spark, d) -> DataFrame:
    """Strict document names and their revision tails."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(NAME).alias("name")).withColumn("n", G.document(F.col("name")))
    tail = G.revision_tail(F.col("n.tail"))
    return x.select("id", "n.contract", "n.title_system", "n.discipline", "n.sheet", tail["revision"].alias("revision"), tail["appendix"].alias("appendix"), tail["language"].alias("language"), tail["file_type"].alias("file_type"), F.col("n").isNotNull().alias("strict"))


@query(f"""
SELECT id, {_groups("x", _L, contract=1, title_system=2, discipline=3, sheet=4, extension=5, tail=6)}, len(regexp_extract_all(x, '{_L}')) AS n_names, {_p("x", f"({G.TITLE_SYSTEM})", 1)} AS first_title
FROM (SELECT o_orderkey AS id, {_dash(NAME)} AS x FROM orders)
""")
def loose_names(spark, d) -> DataFrame:
    """Relaxed document names, how many a text holds, and its first title and system."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(NAME).alias("name")).withColumn("n", G.document(F.col("name"), loose=True))
    found = F.size(F.regexp_extract_all(G.dashes(F.col("name")), F.lit(_L), F.lit(0))).cast("long")
    return x.select("id", "n.contract", "n.title_system", "n.discipline", "n.sheet", "n.extension", "n.tail", found.alias("n_names"), G.part(G.dashes(F.col("name")), f"({G.TITLE_SYSTEM})", 1).alias("first_title"))


FOLDER = """CASE o_orderkey % 10
 WHEN 0 THEN concat(o_custkey % 100, '_рев.', o_custkey % 7, '-AN', o_custkey % 20, '_2879-SOT')
 WHEN 1 THEN concat(o_custkey % 100, '_') WHEN 2 THEN '1513' WHEN 3 THEN concat('0', o_custkey % 10, ' As-Built')
 WHEN 4 THEN concat('0', o_custkey % 10, '_Rev V_4130-KSB1.2_Void') WHEN 5 THEN 'Для передачи' WHEN 6 THEN concat('11_SPP', o_custkey % 3)
 WHEN 7 THEN concat(' 0', o_custkey % 10, ' - void ') WHEN 8 THEN concat('12', o_custkey % 10, '_рев.1') ELSE '03_отправка рев 2' END"""
_STRIP = "regexp_replace({}, '^[ ._-]+|[ ._-]+$', '', 'g')"


@query(f"""
WITH f AS (SELECT o_orderkey AS id, {_dash(FOLDER)} AS x FROM orders),
 g AS (SELECT *, trim(x) AS b, {_p("trim(x)", G.SEQUENCE, 1)} AS s, {_p("x", f"({G.TITLE_SYSTEM})", 1)} AS t FROM f),
 h AS (SELECT *, {_STRIP.format("regexp_replace(" + _STRIP.format(f"regexp_replace({_STRIP.format(chr(114) + 'egexp_replace(b, ' + chr(39) + '^' + chr(92) + 's*' + chr(92) + 'd{1,2}' + chr(39) + ', ' + chr(39) * 2 + ')')}, '{G.AS_BUILD}', '', 'g')") + f", '{G.VOID}', '', 'g')")} AS rest FROM g)
SELECT id, s::INT AS sequence, {_groups("x", G.FOLDER_REVISION, revision=1, appendix=2)}, split_part(t, '-', 1) AS title, regexp_replace(t, '^[0-9]+-', '') AS mark, regexp_matches(x, '{G.AS_BUILD}') AS as_build,
  regexp_matches(x, '{G.VOID}') AS void, regexp_matches(b, '{G.GATE}') AS gate, s IS NOT NULL AND NOT regexp_matches(b, '^[0-9]{{4}}$') AND NOT regexp_matches(b, '{G.GATE}') AND (regexp_matches(b, '{G.FOLDER_REVISION}') OR rest = '') AS issued,
  s IS NOT NULL AND NOT regexp_matches(b, '^[0-9]{{4}}$') AS issued_under_gate FROM h
""")
def transfer_folders(spark, d) -> DataFrame:
    """Transfer folder names: sequence, revision, flags, and whether they are issued packages."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(FOLDER).alias("name"))
    return x.withColumn("f", G.folder(F.col("name"))).select("id", "f.*", G.folder(F.col("name"), under_gate=True)["issued"].alias("issued_under_gate"))


CELL = """CASE o_orderkey % 8 WHEN 0 THEN concat('Рев. 0', o_custkey % 10, '-AN', o_custkey % 20) WHEN 1 THEN concat(o_custkey % 30, '') WHEN 2 THEN 'V' WHEN 3 THEN concat('0–АН0', o_custkey % 10)
 WHEN 4 THEN 'b' WHEN 5 THEN '' WHEN 6 THEN 'Revision S-AN1' ELSE '??' END"""


def _revision(x: str) -> tuple[str, str]:
    raw = f"trim(regexp_replace(replace(replace(trim({_dash(f'coalesce({x}, {chr(39) * 2})')}), 'АН', 'AN'), 'ан', 'AN'), '{G.REVISION_PREFIX}', ''))"
    found = _p(raw, G.REVISION_BODY, 1)
    rev = f"CASE WHEN {found} IS NOT NULL THEN CASE WHEN try_cast({found} AS INT) = 0 THEN '0' WHEN try_cast({found} AS INT) IS NOT NULL THEN lpad(try_cast({found} AS INT)::VARCHAR, 2, '0') ELSE {found} END WHEN regexp_matches({raw}, '^[A-Za-z]$') THEN upper({raw}) END"
    return rev, f"CASE WHEN {found} IS NOT NULL THEN {_p(raw, G.REVISION_BODY, 2)} END"


_REV, _APP = _revision("cell")


@query(f"""
WITH c AS (SELECT o_orderkey AS id, {CELL} AS cell FROM orders), r AS (SELECT id, {_REV} AS revision, {_APP} AS appendix FROM c)
SELECT id, revision, appendix, CASE WHEN coalesce(revision, '') = '' THEN '' WHEN appendix IS NULL THEN revision ELSE revision || '-AN' || appendix END AS shown,
  CASE WHEN upper(revision) = 'V' THEN -2 WHEN upper(revision) = 'S' THEN -1 WHEN regexp_matches(revision, '^[0-9]+$') THEN revision::INT ELSE -3 END AS rank, coalesce(try_cast(appendix AS INT), -1) AS appendix_rank FROM r
""")
def sheet_revisions(spark, d) -> DataFrame:
    """Revision cells as pairs, their text again, and their rank."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), G.sheet_revision(F.expr(CELL)).alias("r")).select("id", "r.*")
    rank = keys.revision_rank(F.col("revision"), F.col("appendix"))
    return x.select("id", "revision", "appendix", G.revision_text(F.col("revision"), F.col("appendix")).alias("shown"), rank["rev"].alias("rank"), rank["app"].alias("appendix_rank"))


LINE = """CASE o_orderkey % 16
 WHEN 0 THEN concat(1 + o_custkey % 28, '.0', 1 + o_custkey % 9, '.2024 Отправлено на ТДО рев. 0', o_custkey % 9, '-AN01 AB.12-TRM-', o_custkey, ' MTO 01')
 WHEN 1 THEN concat('1.2.2024 прошла ТДО X-TRM-', o_custkey % 7, ', X-TRM-', o_custkey % 7, ' MTO Нет auto') WHEN 2 THEN 'Код А' WHEN 3 THEN 'код С рев. 2' WHEN 4 THEN 'код Б' WHEN 5 THEN '3.4.2024 загрузка в СР'
 WHEN 6 THEN 'отправлена на вх. контроль' WHEN 7 THEN 'прошла входной контроль рев.V' WHEN 8 THEN 'ДУП' WHEN 9 THEN 'корректировка auto' WHEN 10 THEN 'согласовано' WHEN 11 THEN 'As-Built рев. АН'
 WHEN 12 THEN '' WHEN 13 THEN concat('замечание ', o_custkey) WHEN 14 THEN '05.06.2024' ELSE 'вх контр' END"""
_REST = "replace(replace(" + _dash(f"CASE WHEN {_p('raw', G.DATED, 1)} IS NOT NULL THEN trim(regexp_extract(raw, '{G.DATED}', 2)) ELSE raw END") + ", 'АН', 'AN'), 'ан', 'AN')"
_OWN, _FILE = _revision(_p("core", G.REVISION_IN_TEXT, 1)), _revision(_p("rest", G.SUFFIX, 2))


@query(f"""
WITH a AS (SELECT o_orderkey AS id, trim({LINE}) AS raw FROM orders), b AS (SELECT *, {_REST} AS rest FROM a), c AS (SELECT *, rtrim(regexp_replace(rest, '{G.SUFFIX}', '')) AS core FROM b)
SELECT id, {_p("raw", G.DATED, 1)} AS date, CASE {" ".join(f"WHEN regexp_matches(core, '{p}') THEN '{k}'" for k, p in G.STAGES)} ELSE 'other' END AS stage, {_OWN[0]} AS revision, {_OWN[1]} AS appendix,
  array_to_string(list_sort(list_distinct(regexp_extract_all(core, '{G.TRANSMITTAL}'))), ',') AS transmittals, {_FILE[0]} AS file_revision, {_p("rest", G.SUFFIX, 1)} IS NOT NULL AS file_absent,
  {_p("rest", G.SUFFIX, 3)} IS NOT NULL OR {_p("rest", G.SUFFIX, 4)} IS NOT NULL AS automatic FROM c
""")
def history_lines(spark, d) -> DataFrame:
    """Lines of history: date, stage, revision, transmittals, and the file-revision mark at the end."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), G.history_line(F.expr(LINE)).alias("e")).select("id", "e.*")
    return x.withColumn("transmittals", F.array_join(F.array_sort("transmittals"), ","))


MARK = "CASE o_orderkey % 8 WHEN 0 THEN concat('SOT', o_custkey % 200, '_IFC') WHEN 1 THEN 'ксб' WHEN 2 THEN ' Пд_ifr ' WHEN 3 THEN 'nanocad' WHEN 4 THEN 'AB3d' WHEN 5 THEN concat('SKUD.', o_custkey % 200) WHEN 6 THEN '' ELSE 'ТО' END"


@query(f"""
WITH m AS (SELECT o_orderkey AS id, regexp_replace(trim({MARK}), '(?i)_IF[CR]$', '') AS b FROM orders), n AS (SELECT id, CASE lower(b) WHEN 'ксб' THEN 'KSB' WHEN 'пд' THEN 'PD' ELSE b END AS mark FROM m)
SELECT id, mark, regexp_matches(mark, '{G.MARK}') AND lower(mark) NOT IN {G.NO_MARKS} AND NOT contains(lower(mark), '3d') AS is_kit FROM n
""")
def kit_marks(spark, d) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), G.mark(F.expr(MARK)).alias("mark"))
    return x.withColumn("is_kit", G.is_mark(F.col("mark")))


TAG = """CASE o_orderkey % 8 WHEN 0 THEN concat('2879-S-VK-', 1000 + o_custkey % 9000) WHEN 1 THEN concat('8950-NDB-07-S-JB-', 1000 + o_custkey % 9000, '(Ex )') WHEN 2 THEN 'S-1' WHEN 3 THEN '2879-S-VK-1'
 WHEN 4 THEN concat('8950-NDB-007-JB-0', 10 + o_custkey % 90, ' and 2879-S-XT-', 1000 + o_custkey % 9000, '(IS)') WHEN 5 THEN '2879-S-VK-' WHEN 6 THEN '' ELSE concat('1234-А-кб-', 1000 + o_custkey % 9000, ';1234-B-AB-0001') END"""


@query(f"""
WITH t AS (SELECT o_orderkey AS id, tag, string_split(tag, '-') AS p FROM (SELECT o_orderkey, {TAG} AS tag FROM orders)), u AS (SELECT *, len(p) AS n, split_part(p[-1], '(', 1) AS q FROM t)
SELECT id, n >= 3 AS valid, CASE WHEN n >= 3 THEN p[1] END AS wbs, CASE WHEN n = 6 THEN p[2] END AS building, CASE WHEN n = 6 THEN p[3] END AS building_number, CASE WHEN n >= 3 THEN p[-3] END AS system, CASE WHEN n >= 3 THEN p[-2] END AS equipment,
  CASE WHEN n >= 3 THEN q END AS sequence, CASE WHEN n >= 3 AND contains(p[-1], '(') THEN regexp_replace(trim(split_part(p[-1], '(', 2)), '^[)]+|[)]+$', '', 'g') END AS code,
  CASE WHEN n >= 3 AND length(q) >= 2 THEN q[1] END AS floor, CASE WHEN n >= 3 AND length(q) >= 2 THEN q[2] END AS subsystem, n >= 3 AND p[-2] IN ('XT') AS hidden,
  array_to_string(list_concat(regexp_extract_all(tag, '{G.TAGS[0]}'), regexp_extract_all(tag, '{G.TAGS[1]}')), '|') AS found FROM u
""")
def tag_grammar(spark, d) -> DataFrame:
    """Tags taken apart, hidden equipment, and all tags that a text holds."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(TAG).alias("tag"))
    out = x.withColumn("t", G.tag(F.col("tag"))).withColumn("found", F.array_join(G.tags_in(F.col("tag")), "|")).select("id", "t.*", "found")
    return out.withColumn("hidden", F.col("valid") & F.coalesce(F.col("equipment") == "XT", F.lit(False)))


TEXT = """CASE o_orderkey % 10 WHEN 0 THEN concat(' a_x000D_b ', o_custkey % 9) WHEN 1 THEN 'NULL' WHEN 2 THEN concat('0', o_custkey % 100, ',', o_custkey % 10, '00') WHEN 3 THEN '-0.0' WHEN 4 THEN '1 234,5'
 WHEN 5 THEN concat('T', o_custkey % 5, ', B; A,,') WHEN 6 THEN 'nan' WHEN 7 THEN concat(o_custkey, '.0') WHEN 8 THEN concat('C:', chr(92), 'Dir', o_custkey % 7, '//x/') ELSE '8950-SOO1' END"""
_CLEAN = "trim(regexp_replace(replace({}, '_x000D_', ''), '[\\s ]+', ' ', 'g'))"


@query(f"""
WITH a AS (SELECT o_orderkey AS id, {TEXT} AS x FROM orders), b AS (SELECT *, {_CLEAN.format("x")} AS c FROM a), e AS (SELECT *, CASE WHEN lower(c) NOT IN ('', 'none', 'null', 'nan') THEN c END AS own, replace(replace(c, ' ', ''), ',', '.') AS n FROM b)
SELECT id, own AS text, CASE WHEN own IS NULL THEN NULL WHEN regexp_matches(n, '^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN
    CASE WHEN n::DECIMAL(30, 10) = 0 THEN '0' ELSE regexp_replace(regexp_replace(n::DECIMAL(30, 10)::VARCHAR, '0+$', ''), '[.]$', '') END ELSE own END AS number,
  array_to_string(list_sort([t FOR t IN [{_CLEAN.format("s")} FOR s IN regexp_split_to_array(x, '[,;]+')] IF lower(t) NOT IN ('', 'none', 'null', 'nan')]), '|') AS tags,
  lower(regexp_replace(regexp_replace(x, '\\s+', '', 'g'), '^(-?[0-9]+)[.]0$', '\\1')) AS packing, lower(regexp_replace(regexp_replace(replace(x, chr(92), '/'), '/+', '/', 'g'), '/$', '')) AS path,
  {_p("trim(x)", r"^(\d{4})-([a-zA-Zа-яА-Я]{2,5}\d{0,2}(?:\.\d)?)$", 1)} AS title, {_p("trim(x)", r"^(\d{4})-([a-zA-Zа-яА-Я]{2,5}\d{0,2}(?:\.\d)?)$", 2)} AS system FROM e
""")
def text_keys(spark, d) -> DataFrame:
    """Texts, canonical numbers, tag lists, packing and path keys, composite titles."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(TEXT.replace("chr(92)", "char(92)")).alias("x"))
    title = G.composite_title(F.col("x"))
    return x.select("id", keys.text(F.col("x")).alias("text"), keys.number(F.col("x")).alias("number"), F.array_join(keys.tags(F.col("x")), "|").alias("tags"), keys.packing_part(F.col("x")).alias("packing"), keys.path_key(F.col("x")).alias("path"), title["title"].alias("title"), title["system"].alias("system"))


RATIO = "CASE o_orderkey % 8 WHEN 0 THEN concat('0,', lpad(concat(o_custkey % 100, ''), 2, '0')) WHEN 1 THEN concat('1/', o_custkey % 12) WHEN 2 THEN '?' WHEN 3 THEN concat('=', o_custkey % 9, ' / 4') WHEN 4 THEN 'a/b' WHEN 5 THEN '' WHEN 6 THEN '0.333' ELSE concat(o_custkey % 50, '') END"


@query(f"""
WITH a AS (SELECT o_orderkey AS id, string_split(replace(regexp_replace(regexp_replace(trim({RATIO}), '^=', ''), '\\s+', '', 'g'), ',', '.'), '/') AS r FROM orders),
 v AS (SELECT id, CASE WHEN len(r) = 1 THEN try_cast(r[1] AS DOUBLE) WHEN len(r) = 2 AND try_cast(r[2] AS DOUBLE) <> 0 THEN try_cast(r[1] AS DOUBLE) / try_cast(r[2] AS DOUBLE) END AS v FROM a),
 n AS (SELECT *, CASE WHEN v > 0 AND v < 1 THEN floor(1 / v + 0.5) END AS n FROM v)
SELECT id, CASE WHEN n BETWEEN 2 AND 100 AND abs(v - 1 / n) <= 0.005 THEN 1 / n ELSE v END AS coefficient FROM n
""")
def coefficients(spark, d) -> DataFrame:
    """Conversion coefficients: numbers, ratios, placeholders; near reciprocals snap."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), keys.coefficient(F.expr(RATIO)).alias("coefficient"))
