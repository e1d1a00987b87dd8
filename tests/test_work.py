"""What queries store on the way is gone when their result is there."""

import pytest

from reckon.plans import contracts, cycles, delivery, derived, folders, headers, outcomes, placement, registry, sinks, vendor  # noqa: F401
from reckon.sources import work

NAMES = ["match_consumable", "allocate_in_phases", "allocate_contract", "connected_groups", "multiset_diff", "send_cycles", "delivery_leftovers", "placed_apart", "outermost_folders", "folder_means", "document_bundles", "contract_managers", "unit_matrix_versions", "rebuilt_kits", "read_sheets", "replaced_partitions", "inserted_once", "newest_snapshot"]


@pytest.mark.parametrize("name", NAMES)
def test_one_folder_stays(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(work, "_base", lambda _: f"file://{tmp_path}")
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    n = out.count()
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1 and out.count() == n


def test_forget(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(work, "_base", lambda _: f"file://{tmp_path}")
    w = work.Work(spark)
    tables = [w.store(spark.range(k + 1)) for k in range(4)]
    w.forget(3)
    assert [t.count() for t in tables[2:]] == [3, 4] and len([p for p in next(tmp_path.iterdir()).iterdir() if p.is_dir()]) == 2
    w.drop()
    assert not list(tmp_path.iterdir())


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "yarn"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        work._base(Session())
