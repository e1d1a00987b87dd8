"""The vendor match as one walk: what it stores on the way, and rows that only demand with two codes brings together."""

import pytest

from reckon.operators import vendor as V
from reckon.plans import vendor as plans
from reckon.sources.work import Work

from .test_vendor import frames, plain, plain_added

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["vendor_match", "vendor_added"])
def test_query_stores_little(spark, monkeypatch, name):
    """Passes that were each stored and dealt out anew took over 50 stored tables."""
    tables = {k: [r.asDict() for r in df.collect()] for k, df in plans.sides(spark, D).items()}
    pairs, stored, store = plain(**tables), [], Work.store
    monkeypatch.setattr(Work, "store", lambda self, df: stored.append(df) or store(self, df))
    got = [tuple(r) for r in getattr(plans, name)(spark, D).collect()]
    want = pairs if name == "vendor_match" else plain_added(pairs, tables["demand"], tables["vendors"], tables["spare"], False)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(stored) < 25


def test_demand_links_codes_of_no_common_replacement(spark):
    """Demand 1 takes b's vendor by its supply's code before demand 2 of code b can, and 3 takes what is left of a."""
    row = lambda n, code, supply: dict(demand_id=n, title="t", tags=["T0"], code=code, supply_tag="T9", supply_code=supply, cabinets=[], size=1.0)
    tables = {
        "demand": [row(1, "a", "b"), row(2, "b", None), row(3, "a", "a"), row(4, None, "b")],
        "vendors": [dict(vendor_id=n, title="t", tag="T0", code=c, cabinets=[], size=None) for n, c in ((1, "b"), (2, "a"), (3, "z"))],
        "spare": [dict(spare_id=1, title="t", tag="T5", code="z", cabinets=[])], "loose": [dict(loose_id=1, title="t", code="b", cabinets=[], units=1)], "replacements": [dict(code="x", new_code="y", place=0)],
    }
    got = [tuple(r) for r in V.vendor_match(**frames(spark, tables)).collect()]
    assert sorted(got, key=str) == sorted(plain(**tables), key=str) and len(got) == 3
