import re
from collections import Counter
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from reckon.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 1 << 70
DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Every order run over every document, step by step."""
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least, fails = {}, []
    for d, t, _ in docs:
        least[t or ""] = min(least.get(t or "", BIG), BIG if d is None else d)
    for d, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": least[t] < (BIG if d is None else d)}
        fails.append((s or "", {k for k, v in own.items() if v}, d in good, d in bad))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                redundant = sum(1 for f in mine if x in f[1] and f[1] & set(order[:k]))
                out[part, "".join(order), k + 1] = (len(left), len(gone), redundant, sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone))
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def clean(n, seed):
    return " ".join(f"w{seed}x{i}" for i in range(n))


ROWS = [
    (1, clean(60, 1), "a"), (2, clean(60, 1), "b"), (3, clean(60, 1), "a"), (4, "short", "a"), (5, "SHORT % text", None), (6, None, "a"), (7, "", "b"), (None, None, None), (None, clean(60, 1), "b"),
    (9, "same " * 80, "c"), (9, "same " * 80, "c"), (10, "same " * 80, "b"), (11, clean(49, 2), "a"), (12, clean(50, 2), "a"), (13, "Ä#" + clean(70, 3), "é"), (14, clean(60, 4) + " " + "Q" * 40, "a"),
    (15, " ".join(["a", "b", "c", "d"] * 20 + [f"z{i}" for i in range(9)]), "a"), (16, clean(30_000, 5), "a"), (17, clean(30_000, 5), "a"), (18, "\x0b" + clean(50, 6) + " x\x85y", "a"),
]
MARKS = [(1, 1, 0), (4, 1, 0), (4, 0, 1), (9, 0, 1), (13, 1, 1), (3, 1, None), (None, 1, 1), (99, 1, 1), (15, None, None)]


def test_like_plain(spark):
    got = rows_of(A.audit(spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(MARKS, LABELS)))
    assert got == plain(ROWS, MARKS)
    assert len(got) == 600 * len({s or "" for _, _, s in ROWS})


def test_order_of_rows_and_clashing_names(spark):
    docs, labels = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(MARKS, LABELS)
    odd = docs.repartition(3).select("*", *[F.lit(1).alias(c) for c in ("part", "mask", "digest", "quality", "id", "l", "n")])
    assert rows_of(A.audit(odd, labels.withColumn("text", F.lit("x")))) == plain(ROWS, MARKS)


def test_hot_text(spark):
    rows = [(i, clean(55, 1) if i % 3 else clean(55, i), f"s{i % 4}") for i in range(600)]
    assert rows_of(A.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))) == plain(rows, [])


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert A.audit(none, spark.createDataFrame(MARKS, LABELS)).collect() == []


def test_edges_and_steps():
    assert len(A.edges()) == 80 and len(A.steps()) == 600
    assert all(sum(w for s, f, w in A.edges() if f == bit) == factorial(5) for bit in (1, 2, 4, 8, 16))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(A.query(spark, d)) == plain(docs, labels)
