from pyspark.sql import functions as F

from reckon.operators import headers as H
from reckon.sources.work import Work

PATTERNS = {"code": "^code", "qty": "^(qty|amount)", "unit": "^unit"}


def test_combined(spark):
    rows = [(["a", "", "", "b", None], ["x", "y", None, "", "z"], ["a / x", "a / y", "", "b", "b / z"]), (["", " q  r "], ["only", "s"], ["only", "q r / s"]), ([], [], []), (["a"], ["", "t"], ["a", "a / t"])]
    df = spark.createDataFrame(rows, "u array<string>, l array<string>, want array<string>")
    for r in df.select(H.combined(F.col("u"), F.col("l")).alias("got"), "want").collect():
        assert r.got == r.want


def test_headers(spark):
    sheets = {
        "plain": [["title"], ["Code", "Unit", "Qty"], ["A", "pc", "1"], ["", " ", None], ["B", None, "2"]],
        "rightmost": [["qty old", "code", "Qty new", "code 2"], ["9", "A", "3", "no"]],
        "two rows": [["Amount", "", "Code"], ["plan", "fact", ""], ["4", "5", "C"]],
        "better later": [["code", "qty"], ["CODE", "qty", "unit"], ["D", "6", "kg"]],
        "first of equals": [["code", "qty"], ["code", "qty"], ["E", "7"]],
        "none": [["code", "unit"], ["F", "pc"]],
        "late": [["x"]] * H.TOP + [["code", "qty"], ["G", "8"]],
        "short rows": [["code", "unit", "qty"], ["H"]],
        "empty": [],
    }
    rows = [(s, k, cells) for s, found in sheets.items() for k, cells in enumerate(found)]
    df = spark.createDataFrame(rows, "sheet string, row long, cells array<string>")
    got = H.read_sheets(df, PATTERNS, ("code", "qty"), "^(plan|fact)$", Work(spark), rightmost=("qty",))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("plain", 2, "A", "1", "pc"), ("plain", 4, "B", "2", None), ("rightmost", 1, "A", "3", None), ("two rows", 2, "C", "5", None), ("better later", 2, "D", "6", "kg"),
        ("first of equals", 1, "code", "qty", None), ("first of equals", 2, "E", "7", None), ("short rows", 1, "H", None, None),
    ], key=str)
    assert H.read_sheets(df.limit(0), PATTERNS, ("code",), "^plan$", Work(spark)).collect() == []
