import re
from collections import defaultdict

from reckon.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(epochs * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def hold(rows, got):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        by[s] += n
    want = targets(by)
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), n) for (d, _, _), n in zip(rows, sizes))
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    top = max(largest.values(), default=0)
    assert sum(taken.values()) <= 1.5 * sum(sizes) + 1e-9 and sum(taken.values()) > 1.5 * sum(sizes) - top - 1
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * top + 1, s


def test_mix(spark):
    rows = [(i, "w " * (i * 7 % 50), f"s{i * i % 7}") for i in range(800)] + [(i, "x y", None) for i in range(900, 960)] + [(1000, None, "empty"), (1001, "", "s1"), (5, "a b c", "s4"), (5, "a b c", "s4"), (None, "q " * 9, "é")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, place int")
    got = M.mix(df).collect()
    hold(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df.repartition(3)).collect()))


def test_hot_source_is_capped(spark):
    rows = [(i, "w " * 20, "b" if i % 3 else f"a{i % 30}") for i in range(900)]
    hold(rows, M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).collect() == []
    assert [r.taken for r in M.mix(spark.createDataFrame([(1, None, "a")], df.schema)).collect()] == [0]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    hold(rows, M.query(spark, d).collect())


def test_manifest_is_that_of_a_plain_queue(spark):
    """Copies taken one by one in order of their finish time until the budget is full, by a heap over the sources."""
    import heapq

    from pyspark.sql import functions as F

    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i * i % 5}" if i % 4 else "hot") for i in range(600)] + [(700, None, "s1"), (701, "", None), (702, "z " * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = dict(map(tuple, df.select("doc_id", F.xxhash64("doc_id", F.lit(7))).collect()))
    queues, sizes = defaultdict(list), defaultdict(int)
    for d, t, s in sorted(rows, key=lambda r: (place[r[0]], r[0])):
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        if n:
            queues[s].append((sizes[s], n, d))
    want, order = targets(sizes), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    offers = {s: iter([((upto + e * sizes[s]) / want[s], rank, n, d) for e in range(2) for upto, n, d in queues[s]]) for rank, s in enumerate(order) if sizes[s]}
    heap = [(next(o), s) for s, o in offers.items()]
    heap = [(*first, s) for first, s in heap]
    heapq.heapify(heap)
    left, taken = 1.5 * sum(sizes.values()), defaultdict(int)
    while heap:
        _, _, n, d, s = heapq.heappop(heap)
        if n > left:
            break
        left -= n
        taken[d] += 1
        if (more := next(offers[s], None)) is not None:
            heapq.heappush(heap, (*more, s))
    assert {r.doc_id: r.taken for r in M.mix(df).collect()} == {d: taken[d] * len(WORD.findall(t or "")) for d, t, _ in rows}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5, "x")], "doc_id long, text string, source string, source_size int, lang string")
    assert M.mix(df, keep=("source_size", "lang")).columns == ["doc_id", "size", "source", "source_size", "target", "epochs", "taken", "lang"]
