"""What is written on the way is gone when a result is there: one folder at most stays, which the result reads."""

import pytest

from reckon.llm import common, queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_leave_their_result_only(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(common, "shared_base", lambda _: f"file://{tmp_path}")
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    out.count()
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) <= 1
    out.count()


def test_the_pipeline_leaves_its_result_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_base", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = out.count()
    folders = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert len(folders) == 1 and len([p for p in folders[0].iterdir() if p.is_dir()]) == 1
    assert out.count() == n
