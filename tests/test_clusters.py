"""Clusters against a plain union of sets: random links, long chains, one value that a third of all ids have."""

import random

from reckon.operators import clusters


def plain(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by = {}
    for i, v in pairs:
        if i is not None:
            root.setdefault(i, i)
            if v is not None:
                by.setdefault(v, []).append(i)
    for ids in by.values():
        for x in ids[1:]:
            a, b = find(ids[0]), find(x)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def check(spark, pairs):
    got = clusters.connected(spark.createDataFrame(pairs, "a long, f string"), "a", "f")
    assert {r.id: r.cluster for r in got.collect()} == plain(pairs)


def test_random_links(spark):
    r = random.Random(4)
    check(spark, [(r.randrange(400), f"v{r.randrange(330)}") for _ in range(450)] + [(7, None), (900, None), (None, "v1"), (3, "x"), (3, "x")])


def test_long_chain(spark):
    order = list(range(700))
    random.Random(1).shuffle(order)
    check(spark, [(order[k + d], f"link{k}") for k in range(699) for d in (0, 1)])


def test_hot_value(spark):
    check(spark, [(k, "hot" if k % 3 == 0 else f"v{k % 5000}") for k in range(30_000)])


def test_no_links(spark):
    check(spark, [(1, "a"), (2, "b"), (3, None)])
    assert clusters.connected(spark.createDataFrame([], "a long, f string"), "a", "f").collect() == []
