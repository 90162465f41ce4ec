"""Edges of a type are read without the plans of the other derived edges."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orgweft.operators import evaluate as E
from orgweft.operators import questions as Q
from orgweft.operators import repairs as R
from orgweft.plans.bundle import canonicalize, complete
from orgweft.plans.corpus import synthetic_org

TYPES = ("COMMUNICATES", "OWNS", "DEPENDS_ON", "AUTHORED", "ABOUT", "REPLIES_TO", "PRECEDED_BY", "REPORTS_TO")


@pytest.fixture(scope="module")
def org(spark):
    records, contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    return complete(canonicalize(records, "d"), contracts)


def _rows(edges):
    return sorted(tuple(row) for row in edges.select("rel_type", "canonical_key", "id").collect())


def test_types_are_the_edges_filtered(org):
    for rel_type in TYPES:
        assert _rows(org.of_type(rel_type)) == _rows(org.edges.where(F.col("rel_type") == rel_type)), rel_type
    assert _rows(org.of_type(*TYPES)) == _rows(org.edges)


def test_other_derived_edges_are_not_planned(org):
    marked = org.of_type("COMMUNICATES").where("canonical_key <> 'no such key'")
    bundle = org.with_types({"COMMUNICATES": marked})
    planned = lambda edges: "no such key" in edges._jdf.queryExecution().analyzed().toString()
    assert planned(bundle.edges) and planned(bundle.of_type("COMMUNICATES"))
    assert not planned(bundle.of_type("OWNS", "DEPENDS_ON"))
    assert _rows(bundle.edges) == _rows(org.edges)


def test_a_frame_put_in_has_no_parts(org):
    some = org.edges.where("rel_type = 'OWNS'").limit(1)
    for bundle in (org.with_edges(some), replace(org, edges=some)):
        assert _rows(bundle.of_type("OWNS")) == _rows(some) and _rows(bundle.of_type("COMMUNICATES")) == []
        assert _rows(bundle.with_types({"OWNS": org.of_type("OWNS")}).edges) == _rows(org.of_type("OWNS"))


def test_overlays_are_in_the_edges_and_their_part(spark, org):
    approved = spark.createDataFrame(
        [("r1", "module:module-01|module:module-02|person:p0001|person:p0002", "establish_owner_bridge")],
        "repair_id STRING, finding_key STRING, repair_kind STRING",
    )
    repaired = R.apply_repairs(org, approved)
    added = set(_rows(repaired.edges)) - set(_rows(org.edges))
    assert len(added) == 1 and added == set(_rows(repaired.of_type("COMMUNICATES"))) - set(_rows(org.of_type("COMMUNICATES")))


def test_checks_of_answers_are_written_apart(spark, org):
    asked = spark.createDataFrame([(1, "Who owns module-03?"), (2, "What time is it?")], "question_id INT, text STRING")
    labels = spark.createDataFrame(
        [(1, "direct", "answered", "direct", None, 1, 1, 0), (2, "none", "unsupported", "unsupported", None, 0, 0, 0)],
        "question_id INT, category STRING, expected_status STRING, expected_answer_kind STRING, "
        "expected_person_keys ARRAY<STRING>, minimum_evidence INT, minimum_paths INT, minimum_conflicts INT",
    )
    checks = E.question_checks(Q.answer_questions(org, asked), labels, org.evidence)
    # No step above the counts has the evidence, nor the joins behind it, in its plan.
    plan = checks._jdf.queryExecution().analyzed().toString()
    assert "evidence_id" not in plan
    got = {r["question_id"]: r for r in checks.collect()}
    assert got[1]["evidence_ok"] and got[1]["evidence_known"] and got[1]["paths_ok"] and not got[1]["people_ok"]
    assert got[2]["passed"]
