"""The pipeline against a plain Python version of each stage, run on the stage's own input."""

import re
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from reckon.llm import quality  # noqa: E402
from tests.llm import test_decontaminate, test_mixing, test_near_dedup, test_quality  # noqa: E402

D = "/root/testdata/sf0.01"


def later_copies(rows, length=50):
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        b = r.text.encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], r.doc_id)
    out = {}
    for r in rows:
        b = r.text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < r.doc_id:
                gone[k : k + length] = b"\1" * length
        kept, at = [], 0
        for ch in r.text:
            n = len(ch.encode())
            if not any(gone[at : at + n]):
                kept.append(ch)
            at += n
        if kept or not b:
            out[r.doc_id] = "".join(kept)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = docs.collect()
    table = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(path := str(tmp_path / re.sub(r"\W", "", name)))
        table[name] = (rows, docs := spark.read.parquet(path), rows := docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, _, after = table["quality rules"]
    assert {r.doc_id for r in before if test_quality.base(r.text)[5]}.isdisjoint(r.doc_id for r in after)
    judged = {r.doc_id for r in quality.judge(spark.read.parquet(f"{D}/documents.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in after} == judged
    before, _, after = table["MinHash near-dedup"]
    assert {r.doc_id for r in after} == {d for d, _, _, kept in test_near_dedup.brute([(r.doc_id, r.text) for r in before]) if kept}
    before, _, after = table["suffix-array dedup"]
    assert {r.doc_id: r.text for r in after} == later_copies(before) and all(r.n_chars == len(r.text) for r in after)
    before, _, after = table["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {x[0] for x in test_decontaminate.brute([(r.doc_id, r.text) for r in before], items) if not x[5]}
    before, _, after = table["mixing to target weights"]
    by, taken = defaultdict(int), defaultdict(int)
    for r in before:
        by[r.source] += len(test_mixing.WORD.findall(r.text))
    for r in after:
        taken[r.source] += r.taken
    largest = max(r.size for r in after)
    assert all(abs(taken[s] - t) <= 2 * largest + 1 for s, t in test_mixing.targets(by).items())


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.columns[0] == "doc_id"


ROWS = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (3, "quite another text " * 30, "en", None, 1), (None, "no id here " * 40, "de", "b", 2), (None, None, None, None, None), (9, "long " * 60_000, "xx", "b", 3)]
CLASHES = ["n_words", "kept", "__hits", "__words", "__m", "__score", "n_bytes", "source_size", "taken", "__id", "size"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_clashing_columns(spark, name):
    """Nulls anywhere, empty and very long texts, repeated rows, rows sharing an id, an empty table, extra columns."""
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in ROWS], schema)
    out = stage(spark, df, "/root/testdata/sf0.001")
    rows = out.collect()
    if name == "mixing to target weights":
        assert {r.doc_id for r in rows} <= {1, 2, 3, 9, None} and all(r.taken > 0 for r in rows)
    else:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    if name == "MinHash near-dedup":
        assert len(rows) == len(ROWS)
    if name == "benchmark decontamination":
        assert len(rows) == len(ROWS)
    if name == "suffix-array dedup":
        assert len(rows) == len(ROWS) and all(r.text is not None for r in rows)
    if name == "quality rules":
        assert {r.doc_id for r in rows} <= {3, 9, None} and all(r.text and len(r.text.split()) >= 50 for r in rows)
    assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    """A copy goes, another text under the same id stays."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (5, text, "en", "a", 1), (5, " ".join(f"v{i}" for i in range(80)), "en", "a", 1)]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), D)
    assert sorted((r.doc_id, r.text[0]) for r in out.collect()) == [(1, "w"), (5, "v")]
