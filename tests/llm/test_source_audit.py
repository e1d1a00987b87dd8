import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reckon.llm import source_audit as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "text string, lang string, source string"


def plain(rows, least=10):
    groups, among, count = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        lang, source, words = lang or "", source or "", [w.translate(LOW) for w in TERM.findall(t or "")]
        groups[lang].add(source)
        among[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in among[lang].items() if n >= least), key=str.encode)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = lambda n, all_: 1 + 10**9 * (n + 2) // (all_ + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = {t: p(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        own = {s: {t: p(count[lang, s][t], total[s]) for t in kept} for s in sources}
        for s in sources:
            found = {"pair": [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s], "term": [(f(own[s][t], q[t]), t) for t in kept if count[lang, s][t] and own[s][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(items) if part == "pair" or k < 10}
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def corpus(n=400):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "Zürich eau the der que 日本 ab𝒳 x".split() for b in ("", "s", "é", "ß", "ing")]
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr", None, "thin"][0 if i % 3 else i % 5]
        k = rng.zipf(1.3, 40) % len(words)
        rows.append((" ".join(words[(int(x) * (1 + i % 4)) % len(words)] for x in k) + f" only{i}, 7 A_b", lang, f"s{i % 7}" if i % 11 else None))
    return rows


ODD = [(None, "en", "s0"), ("", "en", "none"), ("123 ...", "zz", "a"), (None, "zz", "b"), (None, None, None), ("word", "one", "x"), ("ends With\x00NUL joined", "en", "s1"), ("the " * 60_000, "en", "s2")] + [("tie Tie TIE", "ties", s) for s in "abc" for _ in range(5)]


@pytest.mark.parametrize("cells, least_chunk", [(S.CELLS, S.LEAST_CHUNK), (8, 1), (40, 3)])
def test_like_plain(spark, cells, least_chunk):
    rows = corpus() + ODD
    assert rows_of(S.divergences(spark.createDataFrame(rows, DOCS).repartition(5), cells=cells, least_chunk=least_chunk)) == plain(rows)


def test_groups_joined_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_GROUPS", 0)
    rows = corpus(120) + ODD
    assert rows_of(S.divergences(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_repeated_rows_and_clashing_names(spark):
    rows = corpus(60) * 3
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(7).alias(c) for c in ("term", "n", "docs", "chunk", "value", "rank", "words")])
    assert rows_of(S.divergences(df)) == plain(rows)


def test_empty(spark):
    out = S.divergences(spark.createDataFrame([], DOCS))
    assert out.collect() == [] and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 9 * 10**15 - 1), st.integers(0, 9 * 10**15))
def test_scaled_is_exact(count, more):
    total = count + more
    if total < 9 * 10**15:
        assert S.scaled(np.array([count], np.int64), total)[0] == 1 + 10**9 * count // total


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("text", "lang", "source").collect()]
    assert rows_of(S.query(spark, d)) == plain(rows)
