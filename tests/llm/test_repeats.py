"""The two repeat-removing operators against brute force."""

import hashlib
import random
import re

import numpy as np

from reckon.llm import common as C
from reckon.llm import repeats as R
from reckon.llm import substring_dedup, suffix_dedup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def by_bytes(rows, length):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def by_words(rows, length):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, text in rows:
        w = SPACE.findall(text or "")
        for k in range(len(w) - length + 1):
            t = tuple(w[k : k + length])
            first[t] = min(first.get(t, key(i)), key(i))
    out = []
    for i, text in rows:
        w = SPACE.findall(text or "")
        gone = [0] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < key(i):
                gone[k : k + length] = [1] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def hard_rows():
    rng = random.Random(5)
    words = ["the", "of", "é", "ab", "abab", "x", "naïve", "zz", "and", "　w"]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(30))
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts.append(p[a:b] if rng.random() < 0.7 else p)
        rows.append((i, rng.choice([" ", "\n", "  ", ""]).join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 300), (None, rows[3][1]), (None, "a" * 100), (7, rows[7][1]), (7, "other " * 30), (204, "ab" * 200), (205, "word " * 100), (206, "word " * 60)]
    rows.append((300, "\n".join(passages) * 40))
    return rows


def test_suffix_dedup(spark):
    rows = hard_rows()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, __text string")
    for length in (50, 20, 9):
        out = suffix_dedup.suffix_array_dedup(df, length=length, bucket_bytes=2000)
        from pyspark.sql import functions as F

        got = sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)
        assert got == by_bytes(rows, length), length


def test_substring_dedup(spark):
    rows = hard_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (13, 5):
        from pyspark.sql import functions as F

        out = substring_dedup.substring_dedup(df, length=length, bucket_bytes=2000)
        got = sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()), key=str)
        assert got == by_words(rows, length), length


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_array_dedup(df).count() == 0
    assert substring_dedup.substring_dedup(df).count() == 0


def test_whole_characters(spark):
    text = "é" * 60
    out = suffix_dedup.suffix_array_dedup(spark.createDataFrame([(1, text), (2, "a" + text[:40] + "bé")], "doc_id long, text string"), whole_characters=True)
    kept = {r.doc_id: bytes(r.kept).decode() for r in out.collect()}
    assert kept[1] == text and kept[2] == "abé"


def test_queries_on_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, suffix_dedup.query(spark, d).collect()), key=str) == by_bytes(rows, 50)
    assert sorted(map(tuple, substring_dedup.query(spark, d).collect()), key=str) == by_words(rows, 13)


def test_messages_cost_little_whatever_the_number_of_shards():
    """Bytes of the anchors' messages, with those of a row around each, by the number of shards."""
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(240_000))
    part = pa.table({"__bucket": pa.array([3], pa.int32()), "__id": pa.array([1], pa.int64()), "__text": pa.array([text])})
    s = R.Symbols(False, 50, 20)
    cost = {}
    for buckets in (400, 4_000, 20_000):
        blobs = R.name_anchors(part, s, buckets // R.SPREAD)["__blob"].to_pylist()
        cost[buckets] = sum(len(b) + 16 for b in blobs)
        assert len(blobs) > 0.95 * buckets / R.SPREAD and max(map(len, blobs)) < 4 * sum(map(len, blobs)) / len(blobs)
    assert cost[4_000] < 1.3 * cost[400] and cost[20_000] < 1.6 * cost[400], cost
    alone = R.name_anchors(part, s, 10_000_000)["__blob"].to_pylist()
    assert sum(len(b) + 16 for b in alone) < 32 * len(alone) * 1.1  # one anchor a message: a row


def test_pack_round_trip():
    parts = (b"", b"x" * 1000, np.arange(5, dtype=np.uint16), np.array([], np.uint64), np.arange(300, dtype=np.int64), np.array([255], np.uint8))
    got = C.unpack(C.pack(*parts))
    assert [x if isinstance(x, bytes) else x.tolist() for x in got] == [x if isinstance(x, bytes) else x.tolist() for x in parts]
    assert len(C.pack(np.array([7], np.uint64))) <= 12


def test_a_hot_anchor_is_compared_by_places(monkeypatch):
    """The same owners, whether an anchor's windows are compared together or by the anchor's place in them."""
    import pyarrow as pa

    rng = random.Random(4)
    seed = "common words of all these texts "
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(rng.randint(0, 25))) + " " + seed * 2 + " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(25))) for i in range(80)]
    for s, decide in ((R.Symbols(False, 50, 20), suffix_dedup.decide), (R.Symbols(True, 13, 4), substring_dedup.decide)):
        parts = {b: pa.table({"__bucket": pa.array([b] * 20, pa.int32()), "__id": pa.array([r[0] for r in rows[b * 20 : b * 20 + 20]], pa.int64()), "__text": pa.array([r[1] for r in rows[b * 20 : b * 20 + 20]])}) for b in range(4)}
        shared = R.find_shared(pa.concat_tables([R.name_anchors(p, s, 1) for p in parts.values()]))
        pick = lambda t, b: t.filter(pa.array([x == b for x in t["__bucket"].to_pylist()], pa.bool_()))
        spans = pa.concat_tables([R.send_spans(p, pick(shared, b), s, 1) for b, p in parts.items()])
        results = []
        for most, hot in ((1 << 17, 4), (64, 1), (1, 0)):
            monkeypatch.setattr(R, "WINDOWS_AT_ONCE", most)
            monkeypatch.setattr(R, "HOT_CHUNKS", hot)
            out = R.decide_owners(spans, s, decide)
            results.append([(b, [x.tolist() for x in C.unpack(m)]) for b, m in zip(out["__bucket"].to_pylist(), out["__blob"].to_pylist(), strict=True)])
        assert results[0] and results[0] == results[1] == results[2]
