"""Derived tables: an incremental run gives what a full one gives, and leaves the other partitions alone."""

import os

from pyspark.sql import functions as F

from reckon.operators import derived, unit_matrix
from reckon.sources.work import Work


def derive_from(df):
    def derive(keys):
        own = df if keys is None else df.join(keys, "k", "left_semi")
        return own.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n"))

    return derive


def files_of(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_rebuild_is_like_a_full_run(spark, tmp_path):
    old = [(k % 50, k, f"x{k}" if k % 7 else None) for k in range(400)]
    new = [r for r in old if r[0] != 3 and r[1] != 17] + [(60, 1, "y"), (61, None, None), (5, 9, "z"), (5, 9, "z")]
    a, b = (spark.createDataFrame(x, "k long, v long, t string") for x in (old, new))
    dirty = derived.dirty_keys(a, b, "k")
    assert {r.k for r in dirty.collect()} == {3, 17, 60, 61, 5}
    path, full = f"{tmp_path}/part", f"{tmp_path}/full"
    derived.build(derive_from(a), path, "k", 64)
    before = files_of(path)
    work = Work(spark)
    touched = derived.rebuild(derive_from(b), dirty, path, "k", 64, work)
    derived.build(derive_from(b), full, "k", 64)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, spark.read.parquet(full).collect()))
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= files_of(path)  # the very files of all other partitions
    assert derived.rebuild(derive_from(b), dirty.limit(0), path, "k", 64, work) == []
    work.drop()


def test_a_partition_that_loses_all_rows(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "x"), (2, 2, "x")], "k long, v long, t string")
    path = f"{tmp_path}/p"
    derived.build(derive_from(a), path, "k", 1000)
    derived.rebuild(derive_from(a.filter("k = 2")), derived.dirty_keys(a, a.filter("k = 2"), "k"), path, "k", 1000, Work(spark))
    assert [r.k for r in spark.read.parquet(path).collect()] == [2]


def test_versions_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/v"
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 0.5, None)], "a long, b double, c string")
    assert unit_matrix.write_if_changed(df, path, 1, None) == 1
    assert unit_matrix.write_if_changed(df.repartition(3), path, 2, 1) == 1 and not os.path.exists(f"{path}/v=2")
    assert unit_matrix.write_if_changed(df.dropDuplicates(), path, 2, 1) == 2


def test_unit_matrix_cases(spark):
    work = Work(spark)
    codes = spark.createDataFrame([("a", "kg", ""), ("b", None, "collision"), ("c", "pc", ""), ("d", "m", "collision"), ("gone", "pc", "x")], "code string, target string, status string")
    pairs = spark.createDataFrame([("a", "kg", 1.0, False), ("a", "t", 1000.0, False), ("b", "pc", 1.0, False), ("c", "pc", 1.0, False), ("c", "box", None, False), ("c", "old", None, False), ("d", "km", 5.0, False)], "code string, unit string, coefficient double, open boolean")
    targets = spark.createDataFrame([("a", "g"), ("z", "pc")], "code string, target string")
    observed = spark.createDataFrame([("a", "t"), ("b", "pc"), ("b", "m"), ("c", "box"), ("c", "new"), ("n", "pc"), ("n", "pc"), (None, "x")], "code string, unit string")
    got_codes, got_pairs = unit_matrix.reconcile(codes, pairs, targets, observed, work)
    assert {r.code: (r.target, r.status) for r in got_codes.collect()} == {"a": ("g", unit_matrix.OPEN), "b": (None, unit_matrix.COLLISION), "c": ("pc", unit_matrix.OPEN), "d": ("m", unit_matrix.OPEN), "gone": ("pc", ""), "n": (None, unit_matrix.NO_TARGET)}
    assert {(r.code, r.unit): (r.coefficient, r.open) for r in got_pairs.collect()} == {
        ("a", "g"): (1.0, False), ("a", "kg"): (None, True), ("a", "t"): (None, True), ("b", "pc"): (1.0, False), ("b", "m"): (1.0, False), ("c", "pc"): (1.0, False), ("c", "box"): (None, True),
        ("c", "old"): (None, False), ("c", "new"): (None, True), ("d", "m"): (1.0, False), ("d", "km"): (None, True), ("gone", "pc"): (1.0, False), ("n", "pc"): (1.0, False),
    }
    again = unit_matrix.reconcile(got_codes, got_pairs, targets, observed, work)
    assert [unit_matrix.fingerprint(x) for x in again] == [unit_matrix.fingerprint(x) for x in (got_codes, got_pairs)]
    work.drop()
