from __future__ import annotations

import hashlib
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orgweft.functions.ids import stable_id
from orgweft.functions.ranking import global_row_number
from orgweft.functions.text import json_text, percent_quote
from orgweft.operators import lenses as L
from orgweft.operators import questions as Q
from orgweft.operators import repairs as R
from orgweft.operators import validate as V
from orgweft.plans import snapshot as S
from orgweft.plans.bundle import build_bundle, canonicalize, ingest_exports
from orgweft.plans.corpus import synthetic_org
from orgweft.plans.load import FOLDERS, LEDGER, edge_rows, ledger_rows, load, loaded_rows, node_rows, verify_load
from orgweft.schemas import SLACK_ROW


def test_stable_id_is_the_hash(spark):
    person = b"team-id"
    payload = b"set|Person|person:ann"
    digest = hashlib.blake2b(payload, digest_size=8, person=person).digest()
    want = int.from_bytes(digest, "big") & (2**63 - 1)
    got = spark.range(1).select(stable_id("set", "Person", F.lit("person:ann"), person=person).alias("i"))
    assert got.first()["i"] == want


def test_json_and_quoting_match_python(spark):
    from urllib.parse import quote

    texts = ['a"b\\c/\n\t\r\b\f', "é✓\x7f", "\x01\x0b\x1a\x1f end", "\\u001F literal", "", "sp ace~*+%"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.select("t", json_text(F.col("t")).alias("j"), percent_quote(F.col("t")).alias("q")).collect():
        assert row["j"] == json.dumps(row["t"], ensure_ascii=False)
        assert row["q"] == quote(row["t"], safe="")


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id"))
    got = global_row_number(df, [F.desc("g"), F.asc("id")], "place", partitions=5).orderBy("place").collect()
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert [(r["g"], r["id"]) for r in got] == want and [r["place"] for r in got] == list(range(1, 1001))


@pytest.fixture(scope="module")
def org(spark):
    records, contracts = synthetic_org(spark, people=150, modules=40, teams=3)
    return build_bundle(records, "synthetic", contracts)


def test_planted_findings(spark, org):
    assert V.bundle_violations(org).count() == 0
    assert V.label_violations(org.nodes).count() == 0
    scores = L.ghost_scores(org.nodes, org.edges)
    assert scores.where("structural_rank = 1").first()["person_key"] == "person:p0007"
    lines = {
        (r["source_module_key"], r["target_module_key"])
        for r in L.faultlines(org.nodes, org.edges, org.evidence).collect()
    }
    assert {("module:module-11", "module:module-28"), ("module:module-22", "module:module-35")} <= lines
    assert ("module:module-01", "module:module-02") not in lines
    gaps = L.gap_findings(org.nodes, org.edges).collect()
    assert {g["phantom_key"] for g in gaps} == {f"artifact:synth-gap-{i}-approval" for i in range(5)}
    assert all(g["predecessors"] == 1 and g["successors"] == 1 for g in gaps)


def test_questions_and_repairs(spark, org):
    asked = spark.createDataFrame(
        [
            (1, "Who owns module-03?"),
            (2, "who AUTHORED synth gap 0 change"),
            (3, "Who approved synth-gap-0-approval?"),
            (4, "Which modules are affected if module-28 changes?"),
            (5, "What time is it?"),
        ],
        "question_id INT, text STRING",
    )
    found = Q.answer_questions(org, asked)
    got = {r["question_id"]: r for r in found.answers.collect()}
    assert got[1]["status"] == "answered" and got[1]["answer"].endswith(" currently owns module-03.")
    assert got[2]["subject_key"] == "artifact:synth-gap-0-change" and got[2]["answer_kind"] == "direct"
    assert got[3]["status"] == "no_answer" and got[3]["subject_key"] == "artifact:synth-gap-0-approval"
    assert got[4]["answer_kind"] == "multi_hop" and "module-11 depends on" in got[4]["answer"]
    assert got[5]["status"] == "unsupported"
    verdicts = {r[0]: r[1] for r in Q.verdicts(found.answers, found.conflicts).collect()}
    assert verdicts == {1: "SUPPORTED", 2: "SUPPORTED", 3: "UNKNOWN", 4: "SUPPORTED", 5: "UNKNOWN"}

    lines = L.faultlines(org.nodes, org.edges, org.evidence)
    proposed = R.propose_repairs(L.gap_findings(org.nodes, org.edges), lines)
    bridges = proposed.withColumn(
        "repair_kind",
        F.when(F.col("finding_kind") == "faultline", F.lit("establish_owner_bridge")).otherwise(F.col("repair_kind")),
    )
    repaired = R.apply_repairs(org, bridges)
    again = R.apply_repairs(repaired, bridges)
    pairs = lines.select("source_module_key", "target_module_key", "source_owner_key", "target_owner_key").distinct()
    assert again.edges.count() == repaired.edges.count() == org.edges.count() + pairs.count()
    firsts = R.propose_repairs(L.gap_findings(org.nodes, org.edges), lines, first=1).where("finding_kind = 'faultline'")
    assert firsts.count() == 1 < pairs.count()
    checked = R.verify_repairs(proposed, R.open_findings(repaired)).collect()
    assert checked and all(row["closed"] for row in checked)


def test_snapshot_round_trip_and_tampering(spark, org, tmp_path):
    root = str(tmp_path / "snap")
    manifest = S.write_snapshot(org, root)
    again = S.write_snapshot(S.read_snapshot(spark, root), str(tmp_path / "copy"))
    assert again["content_sha256"] == manifest["content_sha256"]
    assert S.snapshot_catalogue(spark, str(tmp_path)).count() == 2
    one = org.evidence.select("evidence_id").first()["evidence_id"]
    assert S.evidence_by_id(spark, root, [one]).count() == 1
    spark.createDataFrame([("added",)], "limitation STRING").write.mode("append").parquet(
        f"{root}/limitations.parquet"
    )
    with pytest.raises(ValueError, match="limitations"):
        S.read_snapshot(spark, root)


def test_load_resumes(spark, tmp_path):
    records, _contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    base = canonicalize(records, "synthetic")
    target = str(tmp_path / "target")
    first = load(base, "snap", target, size=20)
    second = load(base, "snap", target, size=20)
    assert first["completed_batches"] == first["attempted_batches"] and first["resumed_batches"] == 0
    assert second["resumed_batches"] == second["attempted_batches"] == first["attempted_batches"]
    expected = node_rows(base.nodes, "synthetic").unionByName(edge_rows(base.edges, base.nodes, "synthetic"))
    assert verify_load(loaded_rows(spark, target), expected).count() == 0
    # A part whose entries are lost, and rows of a write that broke off, are written over.
    lost = ledger_rows(spark, target).where("batch > 0").collect()
    spark.createDataFrame(lost, LEDGER).write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{target}/ledger")
    third = load(base, "snap", target, size=20)
    assert third["resumed_batches"] == len(lost) < third["completed_batches"] == first["attempted_batches"]
    assert verify_load(loaded_rows(spark, target, "snap"), expected).count() == 0
    other = expected.withColumn("properties", F.when(F.col("stage") == "nodes", F.lit("{}")).otherwise(F.col("properties")))
    assert {r["stage"] for r in verify_load(loaded_rows(spark, target), other).collect()} == {"nodes"}
    cut = replace(base, nodes=base.nodes.where("label <> 'Module'"))
    with pytest.raises(ValueError, match="endpoint"):
        load(cut, "snap", target, size=20)
    with pytest.raises(ValueError, match="changed"):
        load(base, "snap", target, size=30)


def test_order_free_and_idempotent(spark):
    records, _contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    once = canonicalize(records, "d")
    twice = canonicalize(records.unionByName(records).orderBy(F.rand(1)), "d")
    for name in ("nodes", "edges"):
        a, b = getattr(once, name), getattr(twice, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_exports_with_unknown_people(spark):
    records, _contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    directory = records.where("kind IN ('directory_person', 'directory_team', 'module')")
    rows = spark.createDataFrame(
        [
            ("m1", 1735700000, "P0001", None, None, ["<Who@else.org>", "p0002"], ["module-01", "nope"], "hi"),
            ("m2", 1735700100, "who@else.org", "m1", "p0001", [], [], "re"),
            ("m3", 1739700100, "p0003", "m0", None, [], [], "late"),
        ],
        SLACK_ROW,
    )
    bundle = ingest_exports(dataset_id="x", directory=directory, slack=rows)
    assert V.bundle_violations(bundle).count() == 0
    notes = sorted(r[0] for r in bundle.limitations.collect())
    assert any(n.startswith("1 source identities") and "who@else.org" in n for n in notes)
    assert any(n.startswith("1 module references") and "nope" in n for n in notes)
    stub = bundle.nodes.where("props.identity_status = 'unresolved'").collect()
    assert len(stub) == 1 and stub[0]["canonical_key"].startswith("person:unresolved-who-")
    talk = {(r[0], r[1]) for r in bundle.of_type("COMMUNICATES").select("source_key", "target_key").collect()}
    assert ("person:p0001", "person:p0002") in talk and (stub[0]["canonical_key"], "person:p0001") in talk
    gap = bundle.nodes.where("label = 'Phantom'").first()
    assert gap["canonical_key"] == "artifact:slack:m0" and gap["props"]["window_position"] == "in_window"


def test_checks_find_broken_rows(spark):
    rows = spark.createDataFrame([(" ", -1, "a", None), ("b", 2, "a", ["x", " "])], "id STRING, occurred_at_epoch BIGINT, author_id STRING, mentions ARRAY<STRING>")
    rules = {tuple(r) for r in V.export_row_violations(rows, ["id", "author_id"], lists=["mentions"]).collect()}
    assert (" ", "id is required") in rules and ("b", "mentions must hold non-empty strings") in rules
    ids = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "c")], "id BIGINT, identity STRING")
    found = {r["rule"] for r in V.id_collisions(ids).collect()}
    assert found == {"one id, two identities", "one identity, two ids"}
    meta = spark.createDataFrame([("s", "e", '{"a":1,"b":{"c":2},"d":null,"f":1.5}')], "source STRING, external_id STRING, metadata_json STRING")
    assert {r["rule"] for r in V.metadata_violations(meta).collect()} == {"metadata.b", "metadata.d"}


def test_quarantine(spark):
    records, contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    clean = build_bundle(records, "d", contracts, strict=True)
    assert clean.quarantine.count() == 0
    author = records.where("kind = 'artifact'").agg(F.min("author_external_id")).first()[0]
    moved = records.where((F.col("kind") == "directory_person") & (F.col("external_id") == author)).withColumn(
        "occurred_at_epoch", F.col("occurred_at_epoch") + 5
    )
    spoiled = records.unionByName(moved)
    one = canonicalize(spoiled, "d")
    two = canonicalize(moved.unionByName(records).repartition(7), "d")
    rules = {(r["stage"], r["rule"]) for r in one.quarantine.collect()}
    assert rules == {("evidence", "record is stated in different ways"), ("edges", "endpoint is missing")}
    assert one.nodes.where(F.col("canonical_key") == f"person:{author}").count() == 0
    assert V.bundle_violations(one).count() == V.bundle_violations(two).count() == 0
    assert one.quarantine.exceptAll(two.quarantine).count() == two.quarantine.exceptAll(one.quarantine).count() == 0
    with pytest.raises(V.CheckFailed, match="evidence"):
        canonicalize(spoiled, "d", strict=True)
    short = contracts.withColumn("steps", F.slice("steps", 1, 1))
    assert {r["rule"] for r in build_bundle(records, "d", short).quarantine.collect()} == {"at least two steps"}
    with pytest.raises(V.CheckFailed, match="contracts"):
        build_bundle(records, "d", short, strict=True)
