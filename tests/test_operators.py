"""Small fixtures for the operators that queries on the driver's tables don't exercise fully."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from reckon.functions import keys
from reckon.operators import allocate, diff, expand, match
from reckon.sources import tables


def test_fifo_equals_greedy(spark):
    rng = random.Random(1)
    d = [(i, rng.choice("ab"), rng.randint(0, 300)) for i in range(60)]
    s = [(i, rng.choice("abc"), rng.randint(0, 300)) for i in range(60)]
    want, left = defaultdict(int), {i: q for i, _, q in s}
    for i, k, q in d:
        for j, k2, _ in s:
            take = min(q, left[j]) if k == k2 else 0
            if take:
                want[k, i, j] += take
                q, left[j] = q - take, left[j] - take
    out = allocate.fifo(spark.createDataFrame(d, "demand_id int, k string, q long"), spark.createDataFrame(s, "supply_id int, k string, q long"), ["k"], ["demand_id"], ["supply_id"], "q", "q")
    assert {(r.k, r.demand_id, r.supply_id): r.allocated for r in out.collect()} == dict(want)


def test_passes_use_each_row_once(spark):
    demand = spark.createDataFrame([(1, "x", "t"), (2, "x", None), (3, "y", "t"), (4, None, None)], "demand_id int, code string, tag string")
    supply = spark.createDataFrame([(9, "x", "u"), (8, "x", "t"), (7, "y", "q"), (6, None, None)], "supply_id int, code string, tag string")
    got = match.passes(demand, supply, [("tag", [("code", "code"), ("tag", "tag")]), ("code", [("code", "code")])], ["demand_id"], ["supply_id"]).collect()
    assert sorted(map(tuple, got)) == [(1, 8, "tag"), (2, 9, "code"), (3, 7, "code")]


def test_multiset_diff_kinds(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), ("e", 1), ("e", 2)], "code string, v int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1), ("e", 3), ("e", None)], "code string, v int")
    got = sorted(((r.code, r.v, r.n_removed, r.n_added, r.kind) for r in diff.multiset_diff(left, right, "code", ["v"]).collect()), key=str)
    want = [("a", 1, 1, 0, "removed"), ("b", 1, 1, 0, "changed"), ("b", 2, 0, 1, "changed"), ("c", 1, 1, 0, "removed"), ("d", 1, 0, 1, "added"), ("e", 1, 1, 0, "removed"), ("e", 2, 1, 0, "removed"), ("e", 3, 0, 1, "added"), ("e", None, 0, 1, "added")]
    assert got == sorted(want, key=str)


def test_demand_units(spark):
    df = spark.createDataFrame([(1, 2.0, ["a", "b", "c"]), (2, 3.0, []), (3, 5.0, ["z"]), (4, 1.5, ["a", "b"]), (5, 0.0, [])], "id int, q double, tags array<string>")
    got = [(r.id, r.unit_tag, r.unit_qty) for r in expand.demand_units(df, "q", "tags", F.lit(False)).orderBy("id").collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 0.0)] + [(2, None, 1.0)] * 3 + [(3, "z", 5.0), (4, "a", 1.5), (5, None, 0.0)], key=str)


def test_normalisers(spark):
    df = spark.createDataFrame([(" ab 1c ", "1 234,50", "V", "3.2.2024"), ("", "x", None, "31.2.2024"), (None, None, "02", None)], "c string, q string, r string, d string")
    got = df.select(keys.code(F.col("c")), keys.quantity(F.col("q")).cast("double"), keys.revision_rank(F.col("r"))["rev"], keys.day(F.col("d")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("AB1C", 1234.5, -2, "2024-02-03"), (None, None, -3, None), (None, None, 2, None)]


def test_positional_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x; 1 ;q\n;;\ny;;z\n")
    out = tables.positional(spark, str(tmp_path), {0: "code", 1: "qty"})
    assert sorted((r.code, r.qty) for r in out.collect() if r.code) == [("x", "1"), ("y", None)] and out.count() == 2
