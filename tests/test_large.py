"""Steps that read or move less than before, with the results they had."""

from pyspark.sql import functions as F

from orgweft.operators import canonicalize as C
from orgweft.operators.lenses import graph_counts
from orgweft.operators.normalize import artifact_records
from orgweft.plans.bundle import build_bundle
from orgweft.plans.corpus import synthetic_org


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_records_are_merged_before_they_are_built(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x", ["m"]), ("a", 1, "x", ["m"]), ("b", 2, "y", ["m", "n"])],
        "id STRING, occurred_at_epoch BIGINT, author STRING, module_keys ARRAY<STRING>",
    )
    col = F.col
    records = artifact_records(rows, "git", "commit", external_id=col("id"), author=col("author"), content=F.lit("t"))
    evidence = C.evidence_of(records, "d")
    twice = evidence.unionByName(evidence.withColumn("observed_epoch", F.when(col("author_external_id") == "x", 9).otherwise(2)))
    merged = C.observed_edge_candidates(twice, evidence.selectExpr("subject_key AS canonical_key"), "d", merged=True)
    found = {r["canonical_key"]: r["rule"] for r in merged.select("canonical_key", "rule").collect()}
    wrong = "edge is stated in different ways"
    assert found == {
        "authorship:x:git:a": wrong, "about:git:a:m": wrong,
        "authorship:y:git:b": None, "about:git:b:m": None, "about:git:b:n": None,
    }
    ids = C.observed_edge_candidates(evidence, evidence.selectExpr("subject_key AS canonical_key"), "d")
    keys = lambda df: {(r["canonical_key"], r["id"], r["props"]["observed_epoch"]) for r in df.collect()}
    once = C.observed_edge_candidates(evidence, evidence.selectExpr("subject_key AS canonical_key"), "d", merged=True)
    assert keys(once) == keys(ids)
    # What is grouped has no ids, which the edges get afterwards.
    grouped = [line for line in _plan(once).splitlines() if "Aggregate [key" in line]
    assert grouped and not any("source_id" in line or "props" in line for line in grouped)


def test_edges_are_counted_without_joining_all_to_all_nodes(spark):
    records, contracts = synthetic_org(spark, people=60, modules=38, teams=1)
    bundle = build_bundle(records, "d", contracts)
    label = {r["canonical_key"]: r["label"] for r in bundle.nodes.collect()}
    edges = bundle.edges.select("source_key", "rel_type", "target_key")
    lost = edges.limit(1).withColumn("target_key", F.lit("artifact:nowhere"))
    expected = {}
    for source, kind, target in edges.collect():
        shape = (label[source], kind, label[target])
        expected[shape] = expected.get(shape, 0) + 1
    counts = graph_counts(bundle.nodes, edges.unionByName(lost))
    found = {tuple(r)[1:4]: r["n"] for r in counts.where("what = 'edges'").collect()}
    assert found.pop(("*", "*", "*")) == sum(expected.values())
    assert found == expected
    assert "rightHint=(strategy=broadcast)" in _plan(counts)


def test_missing_endpoints_of_every_kind(spark):
    edges = spark.createDataFrame(
        [("e1", "person:a", "artifact:x"), ("e2", "person:b", "artifact:y"), ("e3", None, "artifact:x")],
        "canonical_key STRING, source_key STRING, target_key STRING",
    )
    nodes = spark.createDataFrame([("person:a",), ("artifact:x",)], "canonical_key STRING")
    found = sorted(map(tuple, C.missing_endpoints(edges, nodes).select("edge_key", "canonical_key").collect()), key=str)
    assert found == [("e2", "artifact:y"), ("e2", "person:b"), ("e3", None)]
