"""Every registered query of the reconciliation engine against its DuckDB equivalent."""

import glob
import os

import duckdb
import pytest

from reckon.plans import checks, contracts, cycles, delivery, derived, folders, grammars, headers, journal, kits, layouts, letters, more, outcomes, pages, placement, registry, rules, sinks, vendor  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(found):
    return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=str)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE])
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    q = con.execute(registry.ORACLE[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(map(tuple, df.select(columns).collect())) == rows(tuple(r[i] for i in at) for r in q.fetchall())


#: Queries whose results must show every branch on the driver's tables: column and values.
BRANCHES = {
    "document_rules": ("rule", set(range(1000, 1020))),
    "multiset_diff": ("kind", {"changed", "renamed", "removed", "added"}),
    "allocate_in_phases": ("phase", {"tag", "untagged", "any"}),
    "position_status": ("status", {"excluded", "untagged", ""}),
    "match_outcome": ("pass", {"tag and code", "unmatched", "supply only"}),
    "overlay_versions": ("status", {"current", "ambiguous", "superseded", "ignored"}),
    "snapshot_upsert": ("state", {"new", "missing", "changed", "same"}),
    "scan_upsert": ("review", {"acknowledged", "pending", "ignored"}),
    "history_lines": ("stage", {"code_a", "code_c", "code_b", "sr_upload", "tdo_passed", "tdo_sent", "incoming_sent", "incoming_passed", "dup", "correction", "agreed", "us_build", "other"}),
    "match_events": ("reason", {1, 2}),
    "unit_gate": ("status", {"fatal: conflicting targets", "fatal: several units and no target", "kept", "identity", "fatal: conflicting coefficients", "fatal: no coefficient", "converted"}),
}
BRANCHES |= {
    "match_consumable": ("pass", {"tag and code", "tag and replacement", "tag and reverse replacement", "code", "replacement"}),
    "allocate_contract": ("phase", {"whole", "partial"}),
    "row_layouts": ("supply", {"position", "section", "cabinet", "system", "empty", "head", "other"}),
    "kit_review_status": ("status", {"agreed", "review", "sent", "not uploaded"}),
    "nearest_origin": ("origin", {"no date", "none", "catalog", "request"}),
    "revision_tiers": ("tier", {0, 1, 2}),
    "working_revisions": ("state", {"only on disk", "ahead", "not on disk", "issued"}),
    "masked_rows": ("row_type", {"position", "system", "section", "cabinet", "empty", "other"}),
    "supply_statuses": ("kind", {"empty", "excluded", "tag replaced", "unknown"}),
    "unit_queues": ("kind", {"unit", "units", "remainder", "more tags than quantity"}),
    "title_sums": ("verdict", {"equal", "equal with untagged", "lost"}),
    "kit_matrix": ("summary", {"revision differs", "missing on disk", "missing with robot", "extra on disk", "no letter", "aligned"}),
    "paired_files": ("status", {"extra", "none", "pair", "ambiguous"}),
    "registry_issues": ("issue", {"repeated id", "unknown customer", "conflicting attributes", "no order in work"}),
    "checked_by_code": ("verdict", {"unknown code", "corrected", "differs", "equal"}),
    "changed_keys": ("change", {"added", "removed", "changed"}),
    "layout_violations": ("reason", {"no title", "skipped folder", "no gate", "no package"}),
    "export_plan": ("action", {"add", "skip", "replace"}),
}
BRANCHES |= {
    "send_cycles": ("reason", {"legalized", "number", "revision", "date", ""}),
    "placement_report": ("fault", {None, "no owner", "several owners", "quantity"}),
    "placed_apart": ("side", {"record", "position"}),
    "placed_mixed": ("side", {"record", "position"}),
    "placement_differences": ("note", {"differs", "only records"}),
    "document_bundles": ("role", {"primary", "extra", "paired", "unpaired"}),
    "contract_managers": ("note", {"", "mixed", "not listed", "no manager", "ambiguous"}),
    "contract_aliases": ("ambiguous", {True, False}),
    "unit_matrix_versions": ("status", {"", "collision", "no target", "needs a coefficient"}),
    "contour_members": ("member", {True, False}),
    "code_origin": ("origin", {"customer", "pi", "unknown"}),
    "mail_replies": ("error", {"", "several kits", "no kit of the transmittal", "no transmittal"}),
    "mail_letters": ("error", {"", "several kits", "no documents", "not a letter of these kinds"}),
}
BRANCHES |= {"row_statuses": ("delivery", {"data problem", "open", "demand only", "supply only", "vendor only", "delivery only", "short", "over", "complete"})}


@pytest.mark.parametrize("name", BRANCHES)
def test_every_branch_occurs(name):
    c = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.01/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    column, values = BRANCHES[name]
    assert {r[0] for r in c.execute(f"SELECT DISTINCT {column} FROM ({registry.ORACLE[name]})").fetchall()} == values
