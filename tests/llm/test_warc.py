import base64
import hashlib
import os

import pytest
import zstandard

from reckon.llm import common as C
from reckon.llm import warc as W


def brute(rows, least=0):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i, key=key)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = len(p) >= least and first[h or ""] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h{i}.com/é\r\nX: y" if i % 7 else None, f"<p>{i % 11}</p>\r\n\r\n" * (i % 5)) for i in range(300)] + [(500, "u", None), (501, "u", ""), (None, "u", "<p>1</p>\r\n\r\n"), (None, "v", "alone"), (3, "http://h3.com", "twice"), (3, "http://h3.com", "twice"), (4, "x", "twice"), (600, "x", "é" * 400_000)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, sha string, first int")
    for least in (0, 1, 100):
        folder = f"file://{tmp_path}/w{least}"
        index = C.written(W.write_bundles(df, folder, least=least, bundle_bytes=2000))
        got = W.read_bundles(index, folder).collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(ROWS, least)
        assert {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"} <= {(i, (h or "").encode()) for i, _, h in ROWS}
    assert [r.page_id for r in W.lookup(index, folder, [600]).collect()] == [600]


def test_bundles_are_seekable_and_plain(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = C.written(W.write_bundles(spark.createDataFrame([(i, "u", f"{i} " * 90_000) for i in range(12)], "page_id long, url string, html string").coalesce(1), folder))
    total = 0
    for name in os.listdir(tmp_path / "w"):
        with open(tmp_path / "w" / name, "rb") as f:
            frames = W.read_seek_table(f, os.path.getsize(tmp_path / "w" / name))
            f.seek(0)
            plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert len(plain) == sum(x[2] for x in frames)
        while plain:
            head, body, size = W.parse(plain)
            assert head["version"] == "WARC/1.1"
            plain, total = plain[size:], total + 1
    assert total == 12 == index.count() and index.agg({"frame": "max"}).first()[0] >= 1


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = C.written(W.write_bundles(df, f"file://{tmp_path}/w"))
    assert W.read_bundles(index, f"file://{tmp_path}/w").count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert sorted(map(tuple, W.query(spark, d).collect()), key=str) == brute(rows)


def test_a_bare_path_is_refused(tmp_path):
    with pytest.raises(ValueError, match="scheme"):
        W.opened(str(tmp_path))
