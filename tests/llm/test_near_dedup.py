import random
import re

import numpy as np

from reckon.llm import near_dedup as N

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets(text, k=5):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    by = [(d, sets(t)) for d, t in rows]
    root = {d: d for d, _ in by if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(by):
        for b, t in by[:i]:
            if a is None or b is None or not s or not t or min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                continue
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = []
    for d, s in by:
        c = None if d is None else find(d) if s else d
        out.append((d, len(s), c, d is None or c == d))
    return sorted(out, key=str)


def rows_with_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, texts = [], []
    for i in range(300):
        r = rng.random()
        if texts and r < 0.6:
            w = rng.choice(texts[-12:]).split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        else:
            t = " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 30, 60, 150])))
        texts.append(t)
        rows.append((i, t.upper() if rng.random() < 0.1 else t.replace(" ", "  ", 1)))
    return rows + [(400, None), (401, ""), (402, " \n"), (None, texts[0]), (403, "w " * 3000), (404, "w " * 9), (5, texts[5])]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_with_copies(seed)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bands string, root int")
        assert sorted(map(tuple, N.near_duplicates(df).drop("text_hash").collect()), key=str) == brute(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = rows_with_copies(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(df).drop("text_hash").collect()), key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
            n = int(2000 * share)
            y = np.concatenate((x[:n], rng.integers(0, 1 << 63, 2000 - n).astype(np.uint64)))
            lines = N.registers(np.concatenate((x, y)), np.array([0, 2000, 4000]))
            errors.append(N.estimate(np.array([(lines[0] == lines[1]).mean()]), np.array([2000]), np.array([2000]))[0] - n / (4000 - n))
        assert abs(np.mean(errors)) < 0.03, share


def test_registers_hold_zeros_and_mantissa():
    v = np.array([1 << 63, (1 << 63) | (1 << 62), 1 << 62, 1 << 20], np.uint64)
    assert N.compress(v).tolist() == [0, 512, 1 << 10, 43 << 10]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 50), (7, 7)]
    got = dict(map(tuple, N.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 100: 50, 101: 50}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, N.query(spark, d).collect()), key=str) == brute(rows)


def test_hot_bucket_of_texts_that_are_alike_but_not_linked(spark, monkeypatch):
    """Two components and strays in common buckets: minor members meet the largest component's blocks."""
    monkeypatch.setattr(N, "BLOCK", 6)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(df).drop("text_hash").collect()), key=str) == brute(rows)


def test_scratch_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N.C, "shared_base", lambda _: f"file://{tmp_path}")
    rows = rows_with_copies(2)
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1 and out.count() == len(rows)
