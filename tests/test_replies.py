"""Replies to letters, by hand."""

import pytest
from pyspark.sql import functions as F

from reckon.functions import replies as R
from reckon.operators import replies as O

TABLE = "\nFrom: A B\nOwner document number\n1 ABCD.287-2879-SOT.MTO-0002 01 a title\n2 ABCD.287-2879-SOT.OD-0001 01-AN02\n"
#: name: (subject, body, folder), (transmittal, incoming, stage, title, mark, revision, documents, kit_by, error)
CASES = {
    "documents on top": (("RE: A–B-TRM-01", "Документы загружены в СР\r\nABCD.287-2879-SOT.MTO-0003_02_RU.pdf abcd.287-2879-sot.od-0001_01_RU ABCD.287-2879-SOT.OD-0001" + TABLE, None), ("A-B-TRM-01", None, "sr_upload", "2879", "SOT", "01", 2, "text", "")),
    "incoming": (("RE: a-TRM-1", "Загрузили в СР, A-trm-1 и Z-TRM-9: загружено" + TABLE, None), ("a-TRM-1", "Z-TRM-9", "incoming_passed", "2879", "SOT", "01-AN02", 2, "text", "")),
    "sent on": (("RE: x", "Направлены на рассмотрение ABCD.287-2879-SOT", None), (None, None, "incoming_passed", "2879", "SOT", None, 1, "text", "")),
    "table gives revisions": (("RE: x", "на рассмотрении ABCD.287-2879-SOT.MTO-0002" + TABLE, None), (None, None, "incoming_passed", "2879", "SOT", "01", 1, "text", "")),
    "several kits": (("RE: x", "Документация принята ABCD.287-2879-SOT.OD-0001 ABCD.287-2880-SOT.OD-0001", None), (None, None, None, None, None, None, 2, "text", "several kits")),
    "thread of several kits": (("RE: s-TRM-1", "Документы приняты\nFrom: x\nABCD.287-2879-SOT.OD-0001 ABCD.287-2880-SOT.OD-0001", None), ("s-TRM-1", None, "incoming_passed", "7002", "SOT", None, 0, "transmittal", "")),
    "prose": (("RE: x", "Документы загружены по титулу 6816 марка\nKSB рев.0", None), (None, None, "sr_upload", "6816", "KSB", "0", 0, "text", "")),
    "prose for a bare OD document": (("RE: x", "ABCD.287-6816-KSB.OD-0001 ABCD.287-6816-KSB.MTO-0002_05 титул 6816 марка KSB рев. 03", None), (None, None, None, "6816", "KSB", "03", 2, "text", "")),
    "prose by name": (("RE: x", "спасибо\nFrom: y\nтитулу ABCD.287-6816-KSB _0, титула 6816 марка ksb рев. 0", None), (None, None, None, "6816", "KSB", "0", 1, "text", "")),
    "prose, two revisions": (("RE: x", "титул 6816 марка KSB рев.0 титул 6816 марка KSB рев.1", None), (None, None, None, "6816", "KSB", None, 0, "text", "")),
    "prose, two kits": (("RE: x", "титул 6816 марка KSB рев.0 титул 6817 марка KSB рев.0", None), (None, None, None, None, None, None, 0, None, "no transmittal")),
    "no mark of a kit": (("RE: x", "титул 6816 марка NANOCAD рев.0", None), (None, None, None, "6816", "NANOCAD", "0", 0, "text", "no kit of documents")),
    "last send wins": (("RE: S-trm-1", "загрузили в СР", None), ("S-trm-1", None, "sr_upload", "7002", "SOT", None, 0, "transmittal", "")),
    "send before folder": (("RE: S-trm-1", "", "1600-KSB"), ("S-trm-1", None, None, "7002", "SOT", None, 0, "transmittal", "")),
    "folder": (("RE: q-TRM-7", "документы загружены", "1600-KSB"), ("q-TRM-7", None, "sr_upload", "1600", "KSB", None, 0, "folder", "")),
    "folder of no kit": (("RE: q-TRM-7", "", "1600-3DX"), ("q-TRM-7", None, None, None, None, None, 0, None, "no kit of documents")),
    "no send": (("RE: q-TRM-7", "", "1600"), ("q-TRM-7", None, None, None, None, None, 0, None, "no kit of the transmittal")),
    "empty": ((None, None, None), (None, None, None, None, None, None, 0, None, "no transmittal")),
}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(name, *given) for name, (given, _) in CASES.items()], "id string, subject string, body string, folder string")
    sends = spark.createDataFrame([("s-TRM-1", "7001", "SOT", 1), (" S-TRM-1 ", "7002", "SOT", 2), ("", "9", "SOT", 3), (None, "9", "SOT", 4)], "transmittal string, title string, mark string, n int")
    found = df.select("id", "folder", R.reply(F.col("subject"), F.col("body"), "ABCD").alias("x")).select("id", "folder", "x.*")
    return {r.id: tuple(r)[1:] for r in O.resolved(found, sends, ["n"], "folder").collect()}


@pytest.mark.parametrize("name", CASES)
def test_reply(read, name):
    assert read[name] == CASES[name][1]


def test_repeated_rows_and_empty_tables(spark):
    row = ("RE: s-TRM-1", "")
    read = lambda rows: spark.createDataFrame(rows, "subject string, body string").select(F.lit(1).alias("id"), R.reply(F.col("subject"), F.col("body"), "ABCD").alias("x")).select("id", "x.*")
    sends = spark.createDataFrame([], "transmittal string, title string, mark string, n int")
    assert [r.error for r in O.resolved(read([row, row]), sends, ["n"]).collect()] == ["no kit of the transmittal"] * 2
    assert O.resolved(read([]), sends, ["n"]).count() == 0
