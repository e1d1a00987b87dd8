import hashlib
import random
import re

from reckon.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=10):
    have = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            have.setdefault(tuple(w[k : k + window]), set()).add(str(i) if i is not None else "null")
    sizes = {len(k) for k in have}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := have.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [1] * n
                    found |= own
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def got(df):
    from pyspark.sql import functions as F

    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    v = ["a", "b", "Ä", "c1", "é"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(v) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 25]))) for k in range(30)] + [(7, "a a a a a a a a a a a a"), (None, "b b b"), (50, None), (51, "..."), (52, "zebra Quagga")]
    docs = [(k, text(rng.randint(0, 200))) for k in range(60)] + [(None, "ZEBRA, quagga! b b"), (61, None), (62, ""), (3, "a " * 500), (3, "a " * 500)]
    docs += [(70, f"x {items[3][1]} y {items[4][1]}")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    assert got(D.find_contamination(df, bench)) == brute(docs, items)
    assert got(D.find_contamination(df, bench, block_bytes=300)) == brute(docs, items)  # several passes
    assert D.decontaminate(df, bench).columns == df.columns
    assert D.find_contamination(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in D.find_contamination(df, bench.limit(0)).collect()} == {0}


def test_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(40))
    doc = "start here " + " ".join(f"w{k}" for k in range(5, 30)) + " stop " + " ".join(f"w{k}" for k in range(12))
    r = D.find_contamination(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([("q", item)], "item_id string, text string")).first()
    assert (r.longest.n_words, r.longest.first_word, r.longest.item_id) == (25, 2, "q") and r.n_hit == 37


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    out = D.query(spark, d).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)


def test_many_items_with_one_window_that_a_document_repeats():
    """k items met k times: one candidate for each place, not k for each."""
    import time

    import numpy as np

    k = 3000
    b = D.Benchmark([(f"{i:05d}", "one two three") for i in range(k)], 10)
    data = ("one two three stop " * k).encode()
    hashes, off = D.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    place, window = D.find(hashes, off, b)
    order = np.lexsort((window, place))
    place, window = place[order], window[order]
    began = time.perf_counter()
    size, item, begin = D.longest(place, window, np.zeros(len(place), np.int64), b, 1)
    assert (size[0], b.items[item[0]], begin[0], len(place)) == (3, "00000", 0, k)
    assert time.perf_counter() - began < 1


def test_longest_match_against_brute_force():
    import numpy as np

    rng = random.Random(9)
    v = ["a", "b", "c"]
    items = [(f"{k:02d}", " ".join(rng.choice(v) for _ in range(rng.choice([2, 4, 6, 12])))) for k in range(12)]
    b = D.Benchmark(items, 4)
    for _ in range(60):
        w = [rng.choice([*v, "z"]) for _ in range(rng.randint(0, 60))]
        data = " ".join(w).encode()
        hashes, off = D.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        place, window = D.find(hashes, off, b)
        order = np.lexsort((window, place))
        place, window = place[order], window[order]
        size, item, begin = D.longest(place, window, np.zeros(len(place), np.int64), b, 1)
        best = (0, 0, -1)
        for name, t in items:
            own = t.split()
            least = min(4, len(own))
            for i in range(len(w)):
                for j in range(len(own)):
                    n = 0
                    while i + n < len(w) and j + n < len(own) and w[i + n] == own[j + n]:
                        n += 1
                    if n >= least and (len(own) >= 4 or n == len(own)):
                        best = max(best, (n, -i, -int(name) - 1))
        assert (int(size[0]), int(begin[0]), int(item[0])) == ((best[0], -best[1], -best[2] - 1) if best[0] else (0, -1, -1)), (w, best)
