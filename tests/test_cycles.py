"""Code origins by hand: every branch; package choice by tiers."""

from datetime import date, datetime


from reckon.operators import cycles as C

D = lambda day: date(2024, 1, day)


def test_code_origins(spark):
    codes = [(1, "code_a", D(5), "01", (D(1), 1)), (2, "code_b", D(5), "01", (D(1), 1)), (3, "code_c", D(5), "01", (D(1), 1)), (4, "code_b", D(5), "01", (D(1), 1)), (5, "code_b", D(5), "01", (D(1), 1)), (6, "code_b", None, "01", (D(4), 60)), (7, "code_b", None, "01", None), (8, "code_b", D(5), "01", None)]
    sends = [(2, 20, D(6), "02"), (2, 21, D(7), "01"), (3, 30, D(6), "01"), (3, 31, D(9), "00"), (4, 40, D(5), "01"), (4, 41, D(4), "02"), (5, 50, D(6), "00"), (6, 61, D(4), "01"), (6, 59, D(4), "03"), (7, 70, D(9), "02"), (8, 80, None, "01")]
    packages = [(4, "rd", False, "02", datetime(2024, 1, 6)), (5, "rd", False, "02", datetime(2024, 1, 4)), (5, "sq", False, "03", None), (5, "rd", True, "03", None), (7, "rd", False, "02", None), (8, "rd", False, "01", None)]
    got = C.code_origins(
        spark.createDataFrame(codes, "kit long, stage string, day date, revision string, last struct<sent:date,send_id:long>"), spark.createDataFrame(sends, "kit long, send_id long, sent date, revision string"),
        spark.createDataFrame(packages, "kit long, source string, grey boolean, revision string, modified timestamp"), lambda c: c,
    )
    assert {r.kit: r.origin for r in got.collect()} == {1: "customer", 2: "customer", 3: "pi", 4: "customer", 5: "unknown", 6: "pi", 7: "customer", 8: "unknown"}


def test_picked_packages(spark):
    packages = [(1, 1, "rd", False, "01", None, 3, False), (2, 1, "rd", False, "02", "01", 1, False), (3, 1, "rd", False, "01", "01", 2, True), (4, 1, "rd", True, "01", "01", 9, False), (5, 1, "sq", False, "01", "01", 9, False), (6, 1, "rd", False, "03", None, None, False), (7, 2, "rd", False, "05", None, None, False), (8, 2, "rd", False, "05", None, None, False)]
    df = spark.createDataFrame(packages, "package_id long, kit long, source string, grey boolean, revision string, material_revision string, sequence int, skipped boolean")
    kits = [(1, None, "01"), (1, "01", "01"), (1, "03", "01"), (1, "09", "01"), (2, "01", "01"), (2, "05", "09"), (3, None, None)]
    got = C.pick_packages(spark.createDataFrame(kits, "kit long, wanted string, official string"), df)
    assert {(r.kit, r.wanted): r.package_id for r in got.collect()} == {(1, None): 1, (1, "01"): 2, (1, "03"): 6, (2, "01"): 8, (2, "05"): 8}


def test_cycles_without_anything(spark):
    sends = spark.createDataFrame([(1, 1, None, None, None, None, False), (2, None, "n", "01", D(1), D(1), True)], "send_id long, kit long, number string, revision string, sent date, received date, legalized boolean")
    events = spark.createDataFrame([], "event_id long, kit long, seq long, stage string, numbers array<string>, revision string, day date")
    packages = spark.createDataFrame([], "package_id long, kit long, source string, grey boolean, revision string, sequence int")
    assert {r.send_id: (r.reason, r.package_id, r.accepted_by, r.code_event) for r in C.match_cycles(sends, events, packages).collect()} == {1: ("", None, None, None), 2: ("legalized", None, None, None)}
    assert C.match_cycles(sends.limit(0), events, packages).collect() == []
