import pytest

from orgweft.operators import canonicalize as C
from orgweft.operators.lenses import gap_findings
from orgweft.plans.bundle import build_bundle, canonicalize, complete, find_gaps, stated_nodes
from orgweft.plans.corpus import synthetic_org
from orgweft.schemas import LABEL_OF_KIND


def test_facts_that_are_not_written_give_the_same_graph(spark):
    records, contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    kinds = [r[0] for r in records.select("kind").distinct().collect() if r[0] not in LABEL_OF_KIND]
    facts = {kind: records.unionByName(records).where(records.kind == kind) for kind in kinds}
    stated = records.where(records.kind.isin(*LABEL_OF_KIND))
    one = build_bundle(records, "d", contracts)
    two = complete(canonicalize(stated, "d", facts=facts), contracts)
    keys = lambda df, *names: sorted(map(tuple, df.select(*names).distinct().collect()))
    assert keys(one.edges, "canonical_key", "id") == keys(two.edges, "canonical_key", "id")
    assert keys(one.evidence, "evidence_id", "metadata_json") == keys(two.evidence, "evidence_id", "metadata_json")
    owned = [link for link in keys(one.edge_evidence, "edge_key", "evidence_id") if link[0].startswith("owns:")]
    assert keys(two.links_of("OWNS"), "edge_key", "evidence_id") == owned != []
    # What reads other kinds does not make them.
    plan = two.evidence.where("predicate = 'artifact'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    with pytest.raises(ValueError, match="state nodes"):
        canonicalize(stated, "d", facts={"artifact": stated})


def test_gaps_are_found_without_making_edges(spark, monkeypatch):
    records, contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    whole = build_bundle(records, "d", contracts)
    expected = sorted(map(tuple, gap_findings(whole.nodes, whole.edges).collect()), key=str)

    def made(*_args, **_kw):
        raise AssertionError("edges of records were made")

    monkeypatch.setattr(C, "observed_edge_candidates", made)
    stated = stated_nodes(records, "d")
    found = find_gaps(stated.evidence, stated.nodes.kept, contracts, "d")
    assert sorted(map(tuple, gap_findings(found.nodes, found.edges.kept).collect()), key=str) == expected != []
