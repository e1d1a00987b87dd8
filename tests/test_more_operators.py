"""Workbooks, unit gate, clusters, incremental state."""

import zipfile

import pytest
from pyspark.sql import functions as F

from reckon.functions import keys
from reckon.operators import allocate, clusters, diff, units
from reckon.sources import workbook
from reckon.streaming import incremental


def make_workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>code</t></si><si><r><t>live</t></r><r><rPr><strike/></rPr><t>gone</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t> </t></is></c></row><row r="5"><c r="A5" t="s"><v>1</v></c></row><row r="90"><c r="A90"><v>9</v></c></row><row r="900"><c r="A900" s="1" t="str"><v>all gone</v></c></row></sheetData></worksheet>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts><font/><font><strike/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row r="3"><c r="AA3"><v>7</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    make_workbook(tmp_path / "x.xlsx")
    got = workbook.workbooks(spark, str(tmp_path), {0: "code", 2: "qty"}, struck=("code",)).select("source_row", "code", "qty", "code_struck").collect()
    assert [tuple(r) for r in got] == [(1, "code", "2.5", None), (5, "live", None, "gone"), (90, "9", None, None), (900, None, None, "all gone")]
    assert [r.v for r in workbook.workbooks(spark, str(tmp_path), {26: "v"}, sheet="B").collect()] == ["7"]


def test_an_end_that_hides_rows_is_an_error(tmp_path):
    make_workbook(tmp_path / "x.xlsx")
    with pytest.raises(ValueError, match="row 90 lies behind 84 empty rows"):
        list(workbook.sheet_rows((tmp_path / "x.xlsx").read_bytes(), stop_after=50))


def test_conflicting_matrix_rows_are_fatal_and_repeated_ones_are_not(spark):
    requests = spark.createDataFrame([(1, "a", "t", "2"), (2, "b", "t", "0,1")], "request_id int, code string, source_unit string, quantity string").withColumn("quantity", F.replace("quantity", F.lit(","), F.lit(".")))
    dimension = spark.createDataFrame([("a", "kg"), ("b", "kg")], "code string, unit string")
    matrix = spark.createDataFrame([("a", "t", "2"), ("a", "t", "3"), ("b", "t", "1/3"), ("b", "t", "1/3")], "code string, source_unit string, coefficient string")
    got = {r.request_id: (r.status, r.converted) for r in units.plan(requests, dimension, matrix).collect()}
    assert len(got) == 2 and got[1][0] == "fatal: conflicting coefficients"
    assert got[2][0] == "converted" and abs(float(got[2][1]) - 0.1 / 3) < 1e-12


def test_revision_rank_and_clean_text(spark):
    rows = [("V", None), ("S", None), ("01", None), ("01", "00"), ("B2", "1"), (None, None), ("10", "x")]
    got = [tuple(r.r) for r in spark.createDataFrame(rows, "a string, b string").select(keys.revision_rank(F.col("a"), F.col("b")).alias("r")).collect()]
    assert [g[:2] for g in got] == [(-2, -1), (-1, -1), (1, -1), (1, 0), (-3, 1), (-3, -1), (10, -1)]
    texts = spark.createDataFrame([("a_x000D_b",), (" None ",), ("1 234,50",), ("-0,0",), ("12e3",)], "t string").select(keys.text(F.col("t")), keys.number(F.col("t"))).collect()
    assert [tuple(r) for r in texts] == [("ab", "ab"), (None, None), ("1 234,50", "1234.5"), ("-0,0", "0"), ("12e3", "12e3")]


def test_renames_and_changes(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), ("e", 5), ("e", 6), (None, 7)], "code string, q int")
    right = spark.createDataFrame([("a", 1), ("b", 9), ("d", 3), ("e", 8), ("f", 7)], "code string, q int")
    got = sorted((r.code or "", r.q, r.kind) for r in diff.multiset_diff(left, right, "code", ["q"]).collect())
    assert got == [("", 7, "renamed"), ("a", 1, "removed"), ("b", 2, "changed"), ("b", 9, "changed"), ("c", 3, "renamed"), ("d", 3, "renamed"), ("e", 5, "removed"), ("e", 6, "removed"), ("e", 8, "added"), ("f", 7, "renamed")]


def test_one_large_row_makes_no_steps(spark):
    demand = spark.createDataFrame([(1, "k", 2_000_000_000, 1), (2, "k", 5, 2)], "demand_id int, k string, q long, o int")
    supply = spark.createDataFrame([(7, "k", 1_999_999_999, 1), (8, "k", 4, 2)], "supply_id int, k string, q long, o int")
    got = sorted(tuple(r)[1:] for r in allocate.fifo(demand, supply, ["k"], ["o"], ["o"], "q", "q").collect())
    assert got == [(1, 7, 1_999_999_999), (1, 8, 1), (2, 8, 3)]


def test_unit_gate(spark):
    requests = spark.createDataFrame([(1, "a", "kg", "3"), (2, "a", "t", "0.5"), (3, "b", "m", "2"), (4, "c", "m", "1"), (5, "c", "kg", "1"), (6, "d", "x", "1"), (7, "e", "pc", "9"), (8, "g", "q", "1")], "request_id int, code string, source_unit string, quantity string")
    dimension = spark.createDataFrame([("a", "kg"), ("d", "y"), ("d", "z"), ("g", "w")], "code string, unit string")
    matrix = spark.createDataFrame([("a", "t", "1000"), ("e", "pc", "1"), ("g", "q", "?")], "code string, source_unit string, coefficient string")
    planned = units.plan(requests, dimension, matrix)
    got = {r.request_id: (r.converted, r.status) for r in planned.collect()}
    assert got[1] == (3.0, "identity") and got[2] == (500.0, "converted") and got[3] == (2.0, "kept") and got[7] == (9.0, "identity")
    assert all(got[i][1].startswith("fatal") for i in (4, 5, 6, 8))
    with pytest.raises(ValueError, match="4 requests"):
        units.apply(planned)


def test_clusters(spark):
    pairs = [(i, f"f{i // 2}") for i in range(1, 8)] + [(3, "x"), (6, "x"), (9, "y")]
    got = dict(map(tuple, clusters.connected(spark.createDataFrame(pairs, "a int, f string"), "a", "f").collect()))
    assert got == {1: 1, 2: 2, 3: 2, 6: 2, 7: 2, 4: 4, 5: 4, 9: 9}


def test_stream_of_scans(spark, tmp_path):
    source = str(tmp_path / "scans")
    schema = "path string, size long, mtime long"
    for rows in ([("a", 1, 1), ("b", 1, 1)], [("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.run_upserts(stream, str(tmp_path / "state"), "path", ["mtime", "size"], str(tmp_path / "check")).awaitTermination()
    got = {r.path: (r.size, r.review) for r in spark.read.parquet(str(tmp_path / "state" / "v=1")).collect()}
    assert got in ({"a": (2, "pending"), "b": (1, "acknowledged"), "c": (1, "pending")}, {"a": (1, "pending"), "b": (1, "acknowledged"), "c": (1, "acknowledged")})


def test_missing_rows(spark):
    old = incremental.upsert(None, spark.createDataFrame([("a", 1), ("b", 1)], "path string, size long"), "path", ["size"])
    old = old.withColumn("review", F.when(F.col("path") == "a", "ignored").otherwise(F.col("review")))
    new = spark.createDataFrame([("a", 5)], "path string, size long")
    got = {r.path: (r.size, r.present, r.review) for r in incremental.upsert(old, new, "path", ["size"]).collect()}
    assert got == {"a": (5, True, "ignored"), "b": (1, False, "acknowledged")}
    assert {r.path: r.present for r in incremental.upsert(old, new, "path", ["size"], reliable=False).collect()} == {"a": True, "b": True}
