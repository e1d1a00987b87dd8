"""Letters of both kinds, by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from reckon.functions import letters as L

SENT = date(2024, 3, 9)
REVIEW = "Transmittal Notification\r\nTransmittal Date\r\n 5.6.2024\n1. ABCD.287-2879-SOT.OD-0001 \\ 01-AN02 \\ text\nmore \\ B - Незначительные\n2. ABCD.287-2879-SOT.MTO-0002 \\ 02 \\ x \\ A - Замечания отсутствуют \\ C - критические\n 3. ABCD.287-2879-SOT.MTO-0003 \\ A \\ no code"
COVER = "Please find attached transmittals X-Y-TRM-17\n1 ABCD.287-2879-SOT.MTO-0002 01 a title\n2 ABCD.287-2879-SOT.OD-0001 V\n3 ABCD.287-2879-SOT.MTO-0002 05\n"
CASES = {
    "notification": (("Notification of Transmittal Number 'A–B-TRM-00012'", REVIEW), ("review codes", "A-B-TRM-00012", date(2024, 6, 5), "2879", "SOT", "01-AN02", "code_b", "?=1,B=1,C=1", 3, "")),
    "by its body": (("Fw: news", REVIEW.replace("Transmittal Date", "Dated")), ("review codes", None, SENT, "2879", "SOT", "01-AN02", "code_b", "?=1,B=1,C=1", 3, "")),
    "commonest": (("x a-TRM-1", "transmittal notification\n" + "\n".join(f"{k}. ABCD.287-2879-SOT.MTO-000{k} \\ 0{k} \\ y \\ {c} - Существенные" for k, c in ((1, "A"), (2, "C"), (3, "C"), (4, "A"), (5, "B")))), ("review codes", "a-TRM-1", SENT, "2879", "SOT", "01", "code_a", "A=2,B=1,C=2", 5, "")),
    "several kits": (("", "transmittal notification 1. ABCD.287-2879-SOT.OD-0001 \\ 01 \\ A - Критические 2. ABCD.287-2880-SOT.OD-0001 \\ 02 \\ x"), ("review codes", None, SENT, None, None, "01", None, "?=1,A=1", 2, "several kits")),
    "no documents": (("", "transmittal notification"), ("review codes", None, SENT, None, None, None, None, "", 0, "no documents")),
    "cover": (("news", COVER), ("cover", "X-Y-TRM-17", SENT, "2879", "SOT", "V", "tdo_sent", "?=2", 2, "")),
    "cover by subject": (("Сопроводительное письмо Q-TRM-5", "nothing"), ("cover", "Q-TRM-5", SENT, None, None, None, None, "", 0, "no documents")),
    "reply": (("RE: news", COVER), ("other", None, None, None, None, None, None, None, None, "not a letter of these kinds")),
    "empty": ((None, None), ("other", None, None, None, None, None, None, None, None, "not a letter of these kinds")),
}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(name, *given) for name, (given, _) in CASES.items()], "name string, subject string, body string").withColumn("sent", F.lit(SENT))
    return {r.name: tuple(r.x) for r in df.select("name", L.letter(F.col("subject"), F.col("body"), F.col("sent")).alias("x")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_letter(read, name):
    assert read[name] == CASES[name][1]
