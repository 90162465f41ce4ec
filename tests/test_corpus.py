from __future__ import annotations

from orgweft.plans.corpus import leader_authorship, leader_ownership, leader_talk, repo_facts
from orgweft.sources.records import classify_repos


def test_curated_corpus(spark):
    groups = spark.createDataFrame(
        [
            (0, "network", ["ann", "bob", "cy"], ["ann"]),
            (1, "storage", ["bob", "ann", "bob", "dee", "eve", "fay"], ["bob"]),
            (2, "api", ["gus"], ["gus"]),
        ],
        "place INT, slug STRING, members ARRAY<STRING>, chairs ARRAY<STRING>",
    )
    needs = spark.createDataFrame([(0, "network", "api", 9)], "place INT, src STRING, dst STRING, weight INT")
    talk = leader_talk(groups, needs, "bridge").orderBy("meta.first_epoch").collect()
    pairs = [(r["meta"]["sender_external_id"], r["meta"]["recipient_external_id"]) for r in talk]
    assert len({tuple(sorted(p)) for p in pairs}) == len(pairs)
    assert pairs[0] == ("ann", "bob") and ("bridge", "gus") not in pairs
    assert ("bridge", "ann") in pairs and ("bridge", "bob") in pairs
    assert [r["meta"]["first_epoch"] for r in talk] == [1735776000 + 40 * i for i in range(len(talk))]
    ranks = {r["external_id"]: r["meta"]["authority_rank"] for r in leader_ownership(groups).collect()}
    assert ranks["owner-dee-storage-2"] == 93 and "owner-fay-storage-4" not in ranks
    counts = [r["meta"] for r in leader_authorship(groups).where("meta.module_external_id = 'network'").collect()]
    assert {c["total_attributed_count"] for c in counts} == {105}

    repos = spark.createDataFrame(
        [
            ("r1", "thing", "x", ["k8s-sig-api"]),
            ("r2", "fast_storage", None, []),
            ("r3", "cni-plugin", "", []),
            ("r4", "zzz", "", []),
        ],
        "repo STRING, name STRING, description STRING, topics ARRAY<STRING>",
    )
    found = classify_repos(repos, groups)
    assert {r[0]: r[1] for r in found.collect()} == {"r1": "api", "r2": "storage", "r3": "network", "r4": None}
    facts = repo_facts(found, groups).collect()
    assert {r["external_id"] for r in facts if r["kind"] == "dependency"} == {
        "dep-repo-r1-api", "dep-repo-r2-storage", "dep-repo-r3-network",
    }
