from __future__ import annotations

import hashlib
import json
from types import SimpleNamespace

from orgweft.catalog.reviews import relation_owners
from orgweft.operators import lenses as L
from orgweft.operators import questions as Q
from orgweft.plans import snapshot as S
from orgweft.plans.bundle import canonicalize
from orgweft.plans.corpus import synthetic_org


def test_plain_snapshot(spark, tmp_path):
    """Tables without endpoint keys, as single Parquet folders and a limitations file."""
    records, _contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    base = canonicalize(records, "plain")
    root = str(tmp_path)
    tables = S.tables_of(base)
    tables["edges"] = tables["edges"].drop("source_key", "target_key")
    for name in ("node_evidence", "edge_evidence"):
        tables[name] = tables[name].drop("node_key", "edge_key")
    for name in ("nodes", "edges", "evidence", "node_evidence", "edge_evidence"):
        tables[name].write.parquet(f"{root}/{name}.parquet")
    (tmp_path / "limitations.json").write_text(json.dumps({"limitations": ["a note"]}))
    got = S.read_plain_snapshot(spark, root, "plain")
    assert got.edges.exceptAll(base.edges).count() == 0 and got.edges.count() == base.edges.count()
    assert [r[0] for r in got.limitations.collect()] == ["a note"]
    note = L.window_note(got.edges, 30).first()[0]
    assert note.endswith("no communication timestamps are available.")
    rows = Q.relation_rows(base.edges, "REPORTS_TO")
    # The first head has fifty reports, of which 25 are kept; the second has nine.
    assert rows.count() == 34
    impact = Q.impact_from_relations(rows, base.edges)
    assert impact.where("owner_key IS NULL").count() == 34


def test_file_checks(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text("[1]")
    digests = S.file_digests(spark, f"{tmp_path}/*.json")
    counts = spark.createDataFrame([("a.json", 0), ("b.json", 1)], "file STRING, records BIGINT")
    right = hashlib.sha256(b"[]").hexdigest()
    expected = spark.createDataFrame(
        [("a.json", right, 0), ("b.json", right, 2), ("c.json", right, 0)],
        "file STRING, sha256 STRING, record_count BIGINT",
    )
    got = {r["file"]: (r["wrong_digest"], r["wrong_count"]) for r in S.file_checks(digests, counts, expected).collect()}
    assert got == {"b.json": (True, True), "c.json": (True, True)}


def test_owner_is_the_best_of_all_relations(spark):
    """The best of forty owners is the last by key."""
    rows = [
        ("OWNS", f"person:p{n:02}", "module:m", f"owns:{n:02}", (1 if n < 39 else 5, 100, 80, 0, None))
        for n in range(40)
    ]
    edges = spark.createDataFrame(
        rows,
        "rel_type STRING, source_key STRING, target_key STRING, canonical_key STRING, props STRUCT<authority_rank: BIGINT, "
        "observed_epoch: BIGINT, confidence: BIGINT, valid_from_epoch: BIGINT, valid_until_epoch: BIGINT>",
    )
    evidence = spark.createDataFrame([(200,)], "observed_epoch BIGINT")
    views = SimpleNamespace(bundle=SimpleNamespace(edges=edges, evidence=evidence))
    assert [tuple(r) for r in relation_owners(views).collect()] == [("module:m", "person:p39", 80)]
    assert Q.relation_rows(edges, "OWNS").count() == 25 and Q.relation_rows(edges, "OWNS", limit=3).count() == 3
