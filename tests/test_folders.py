"""Nested folders against a plain loop, subset sums against a plain recursion, and edge rows of bundles and means."""

import random
import re
import time

from reckon.operators import folders, subset
from reckon.plans import folders as plans
from reckon.sources.tables import table
from reckon.sources.work import Work


def plain_subset(values, target):
    if target < 0:
        return None
    memo = {}

    def walk(i, left):
        if left == 0:
            return ()
        if i >= len(values) or left < 0:
            return None
        if (i, left) not in memo:
            rest = walk(i + 1, left - values[i])
            memo[i, left] = (i, *rest) if rest is not None else walk(i + 1, left)
        return memo[i, left]

    found = walk(0, target)
    return None if found is None else list(found)


def test_first_indices_like_the_recursion():
    r = random.Random(2)
    for _ in range(3000):
        values = [r.choice([0, 1, 2, 3, 5, 8, 13]) for _ in range(r.randint(0, 12))]
        target = r.randint(-1, 30)
        assert subset.first_indices(values, target) == plain_subset(values, target), (values, target)


def test_work_of_a_subset_sum():
    """4,000 terms and a target of a million: 4 * 10^9 cells, in bits."""
    r = random.Random(3)
    values = [r.randint(1, 500) for _ in range(4000)]
    began = time.time()
    found = subset.first_indices(values, 500_000)
    assert sum(values[k] for k in found) == 500_000 and time.time() - began < 30


def test_subset_query(spark):
    d = "/root/testdata/sf0.001"
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey s", "date_format(l_shipdate, 'yyyyMM') m", "xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) id", "cast(l_quantity as long) v").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r.id):
        groups.setdefault((r.s, r.m), []).append((r.id, r.v))
    want = set()
    for key, terms in groups.items():
        values = [v for _, v in terms]
        for k in plain_subset(values, sum(values) * 2 // 5) or []:
            want.add((*key, k, *terms[k]))
    assert {tuple(r) for r in plans.subset_terms(spark, d).collect()} == want


def plain_outermost(rows):
    best = {}
    for i, p in rows:
        if p is not None and (k := folders_key(p)) != "/":
            best[k] = min(best.get(k, i), i)
    kept = []
    for k in sorted(best, key=lambda k: (len(k), k)):
        if not any(k.startswith(p) for p in kept):
            kept.append(k)
    return {(best[k], k) for k in kept}


def folders_key(p):
    return re.sub(r"[/\\]+", "/", p.strip(" ").lower() + "/")


def test_outermost_like_a_loop(spark):
    r = random.Random(6)
    parts = ["a", "A", "b", "a!", "a b", "é", "x-y", "a0"]
    rows = [(k, r.choice(["/", "\\", "//"]).join(r.choice(parts) for _ in range(r.randint(1, 5)))) for k in range(600)]
    rows = [x for x in rows if len(x[1]) > 4] + [(1000, "a b"), (1001, None), (1002, "A B/"), (1003, "a/b/a/b/a"), (1004, ""), (1005, "zz")]
    rows += [(2000 + k, f"deep/{k % 300:04d}/x/{k}") for k in range(3000)] + [(9000, "deep/0100"), (9001, "deep/0200/x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = folders.outermost(spark.createDataFrame(rows, "folder_id long, path string").repartition(3), Work(spark))
            assert {tuple(x) for x in got.collect()} == plain_outermost(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert folders.outermost(spark.createDataFrame([], "folder_id long, path string"), Work(spark)).collect() == []


def test_everything_below_one_folder(spark):
    rows = [(k, f"root/{k}") for k in range(500)] + [(900, "root")]
    got = folders.outermost(spark.createDataFrame(rows, "folder_id long, path string"), Work(spark))
    assert [tuple(r) for r in got.collect()] == [(900, "root/")]


def test_means_without_own(spark):
    rows = [(1, "f", "a", 10), (2, "f", "a", 20), (3, "f", "b", 31), (4, "f", "c", None), (5, "f", "d", 0), (6, "g", "a", 7), (7, "f", "b", 2**62)]
    got = {r.file_id: (r.mean, r.used, r.skipped) for r in folders.means_without_own(spark.createDataFrame(rows, "file_id long, folder string, stem string, time long"), Work(spark)).collect()}
    mean = lambda x: sum(x) // len(x)
    assert got == {1: (mean([31, 2**62]), 2, 2), 2: (mean([31, 2**62]), 2, 2), 3: (15, 2, 2), 7: (15, 2, 2), 4: (mean([10, 20, 31, 2**62]), 4, 1), 5: (mean([10, 20, 31, 2**62]), 4, 1), 6: (None, 0, 1)}


def test_bundles(spark):
    rows = [(1, "t", "pdf", "a/b", 5, False), (2, "t", "pdf", "a/b", 9, False), (3, "t", "pdf", "a/b", 9, False), (4, "t", "dwg", "A/B/DWG", 1, False), (5, "t", "dwg", "a/dwg", 1, False), (6, "t", "docx", "a/c", 1, False), (7, "t", "docx", "a/b", 1, False), (8, "u", "docx", "x", 1, False), (9, None, "pdf", "q", None, True), (10, None, "pdf", "q", 8, False), (11, None, "xlsx", "q", 1, False)]
    got = {r.file_id: (r.role, r.primary_id) for r in folders.bundles(spark.createDataFrame(rows, "file_id long, title string, kind string, folder string, time long, current boolean"), ["title"], Work(spark)).collect()}
    assert got == {1: ("extra", None), 2: ("primary", 2), 3: ("extra", None), 4: ("paired", 2), 5: ("paired", 2), 6: ("unpaired", None), 7: ("paired", 2), 8: ("unpaired", None), 9: ("primary", 9), 10: ("extra", None), 11: ("paired", 9)}
