"""Steps whose cost grew faster than their input, with the results they had."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orgweft.catalog.views import Views
from orgweft.operators import canonicalize as C
from orgweft.operators import graph as G
from orgweft.operators import identity as I
from orgweft.operators import validate as V
from orgweft.operators.normalize import artifact_records
from orgweft.plans.bundle import canonicalize
from orgweft.plans.corpus import synthetic_org
from orgweft.sources import chat, commits


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _records(spark, rows):
    made = spark.createDataFrame(rows, "id STRING, occurred_at_epoch BIGINT, author STRING, module_keys ARRAY<STRING>")
    return artifact_records(
        made, "git", "commit", external_id=F.col("id"), author=F.col("author"), content=F.lit("t")
    )


def test_statements_are_reduced_only_where_their_keys_come_twice(spark, monkeypatch):
    once = [("a", 1, None, []), ("b", 2, None, [])]
    whole = canonicalize(_records(spark, [*once, ("b", 2, None, []), ("c", 3, None, []), ("c", 4, None, [])]), "d")
    assert {tuple(r) for r in whole.quarantine.collect()} == {("evidence", "git/git:c", C.RECORD_CONFLICT)}
    ids = sorted(r[0] for r in whole.evidence.select("source_record_id").collect())
    assert ids == ["git:a", "git:b"] and whole.nodes.count() == 2

    def made(*_args, **_kw):
        raise AssertionError("whole rows were reduced")

    monkeypatch.setattr(C, "reduced", made)
    monkeypatch.setattr(V, "reduced", made)
    plain = canonicalize(_records(spark, once), "d")
    assert plain.nodes.exceptAll(whole.nodes).count() == whole.nodes.exceptAll(plain.nodes).count() == 0


def test_links_are_not_read_where_all_evidence_is_known(spark):
    records, _contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    base = canonicalize(records, "d")
    broken = base.edge_evidence.withColumn("evidence_id", F.raise_error(F.lit("links were read")).cast("string"))
    assert V.bundle_violations(replace(base, edge_evidence=broken)).count() == 0
    one = base.node_evidence.agg(F.min("evidence_id")).first()[0]
    less = replace(base, evidence=base.evidence.where(F.col("evidence_id") != one))
    links = base.node_evidence.select("node_key", "evidence_id").union(base.edge_evidence.select("edge_key", "evidence_id"))
    expected = {(r[0], "evidence is unknown") for r in links.where(F.col("evidence_id") == one).collect()}
    assert {tuple(r) for r in V.bundle_violations(less).collect()} == expected != set()
    twice = replace(base, evidence=base.evidence.union(base.evidence.where(F.col("evidence_id") == one)))
    assert [tuple(r) for r in V.bundle_violations(twice).collect()] == [(one, "evidence id is not unique")]


def _talk(spark, folder):
    people = [(k, f"Supplier#{k}", k % 3, 100.0 * k) for k in range(10)]
    spark.createDataFrame(people, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE").write.parquet(
        f"{folder}/supplier.parquet"
    )
    rows = [(o, o * 3 % 17, o % 10, 1, 5.0, 10.0 + o, "R") for o in range(40)]
    lines = spark.createDataFrame(
        rows + rows[:9],
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_returnflag STRING",
    )
    lines.withColumn("l_shipdate", F.timestamp_seconds("l_orderkey")).write.parquet(f"{folder}/lineitem.parquet")
    return Views(spark, str(folder))


def test_pairs_of_talk_are_found_without_reducing_records(spark, tmp_path):
    v = _talk(spark, tmp_path)
    names = ("canonical_key", "rel_type", "source_key", "target_key")
    keys = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert keys(v.talk_pairs) == keys(v.talk_edges) != []
    # One grouping, by hash; records would be sorted by their ids.
    assert "SortAggregate" not in _plan(v.talk_pairs) and "l_extendedprice" not in _plan(v.talk_pairs)


def test_edges_of_candidates_are_grouped_by_hash(spark, tmp_path):
    v = _talk(spark, tmp_path)
    nodes = canonicalize(v.people, "d").nodes
    plan = _plan(I.identity_candidates(nodes, v.talk_pairs))
    assert not [line for line in plan.splitlines() if "SortAggregate" in line and "edge_key" in line]


def test_chat_files_are_written_by_tasks_and_parsed_once(spark, tmp_path):
    rows = [(f"channel=c{k}", json.dumps([{"user": f"u{k}", "ts": f"{k}.5", "text": "é\n"}])) for k in range(3)]
    chat.write_chat_days(spark.createDataFrame(rows, "channel STRING, value STRING"), f"file:{tmp_path}")
    found = chat.slack_export_rows(spark, str(tmp_path))
    assert sorted((r["id"], r["author_id"], r["text"]) for r in found.collect()) == [
        (f"channel=c{k}-{k}.5", f"u{k}", "é\n") for k in range(3)
    ]
    assert "FileScan json" not in _plan(found)


def test_commit_logs_are_parsed_once(spark, tmp_path):
    text = "o1\x1f5\x1fA@x\x1fhi\x1fbody\n\nsrc/a/p.py\nsrc/a/q.py\nsrc/b/p.py\n\x1e\n \t\n\x1eo2\x1f6\x1fB@x\x1fho\x1f\n"
    (tmp_path / "log").write_text(text)
    prefixes = spark.createDataFrame([("src/a/", "m"), ("src", "s"), ("src/a", "n")], "prefix STRING, module STRING")
    found = commits.git_log_rows(spark, str(tmp_path / "log"), prefixes)
    assert sorted((r["sha"], r["module_keys"]) for r in found.collect()) == [("o1", ["m", "n", "s"]), ("o2", [])]
    assert "FileScan text" not in _plan(found)


@pytest.mark.parametrize("few", [0, 500_000])
def test_paths_meet_prefixes_few_or_many(spark, monkeypatch, few):
    monkeypatch.setattr(commits, "FEW", few)
    paths = spark.createDataFrame([("1", "a/b/c"), ("1", "a/b/d"), ("2", "x/y")], "id STRING, path STRING")
    prefixes = spark.createDataFrame([("a/b/", "m"), ("a", "n")], "prefix STRING, module STRING")
    assert [tuple(r) for r in commits.path_modules(paths, prefixes).collect()] == [("1", ["m", "n"])]


def test_levels_of_a_walk_need_one_shuffle(spark, monkeypatch):
    arcs = spark.createDataFrame([(f"p{a}", f"p{b}") for a in range(12) for b in (a + 1, a * 5 % 12)], "src STRING, dst STRING")
    graph = G.build_graph(arcs, arcs.select(F.col("src").alias("v")))
    assert graph.small
    plans = []
    step = G.Scratch.step
    monkeypatch.setattr(G.Scratch, "step", lambda self, df, name: plans.append(_plan(df)) or step(self, df, name))
    near = {r["v"]: round(r["centrality"], 9) for r in G.betweenness_bounded(graph, G.all_sources(graph), 4).collect()}
    assert plans and all(plan.count("Exchange hashpartitioning") <= 2 for plan in plans)
    far = replace(graph, small=False)
    assert near == {r["v"]: round(r["centrality"], 9) for r in G.betweenness_bounded(far, G.all_sources(far), 4).collect()}
    assert any(near.values())
