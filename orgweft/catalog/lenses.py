"""Queries over owners, faultlines, gaps and the evidence behind findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.catalog.registry import query
from orgweft.catalog.views import Views
from orgweft.operators import lenses as L


@query("effective_owners", "SELECT module AS module_key, owner AS owner_key, confidence FROM owners")
def effective_owners(v: Views) -> DataFrame:
    return L.effective_owners(v.kept("OWNS"), v.observed)


def talk_faultlines(v: Views) -> DataFrame:
    return L.faultlines(v.people_nodes, v.coordination.of_type("COMMUNICATES", "OWNS", "DEPENDS_ON"), v.observed)


@query(
    "faultlines",
    """SELECT k AS dependency_key, sm AS source_module_key, tm AS target_module_key, so AS source_owner_key, t_o AS target_owner_key,
              w AS dependency_weight, sc AS source_owner_confidence, tc AS target_owner_confidence,
              distance AS communication_distance, tier, CAST(severity AS DOUBLE) AS severity FROM faults""",
)
def faultlines(v: Views) -> DataFrame:
    return talk_faultlines(v)


@query(
    "naive_faultlines",
    """WITH x AS (SELECT l.owner AS a, r.owner AS b, t.d FROM depends d JOIN owns l ON l.module = d.a JOIN owns r ON r.module = d.b
                  LEFT JOIN (SELECT * FROM dist WHERE d <= 4) t ON t.s = l.owner AND t.v = r.owner)
       SELECT count(*) AS round_trips, count(CASE WHEN a <> b AND d IS NULL THEN 1 END) AS open_faultline_pairs FROM x""",
)
def naive_faultlines(v: Views) -> DataFrame:
    return L.naive_faultlines(v.people_nodes, v.coordination.of_type("COMMUNICATES", "OWNS", "DEPENDS_ON"))


@query(
    "naive_owner",
    """SELECT module AS module_key, (SELECT owner FROM owns x WHERE x.module = o.module ORDER BY authority_rank DESC, owner LIMIT 1) AS authority_owner
       FROM owns o GROUP BY module""",
)
def naive_owner(v: Views) -> DataFrame:
    return L.baseline_owners(v.kept("OWNS")).select("module_key", "authority_owner")


@query(
    "gap_findings",
    """SELECT phantom AS phantom_key, expected AS expected_kind, reason, CASE WHEN reason <> 'dangling_thread_parent' THEN epoch END AS inferred_epoch, preds AS predecessors, succs AS successors,
              first_pred AS first_predecessor, first_succ AS first_successor, pos AS window_position, days AS days_after_corpus_start FROM gaprows""",
)
def gap_findings(v: Views) -> DataFrame:
    """The epoch of a thread parent follows from evidence ids and is left off the comparison."""
    found = v.gap_findings
    stated = F.when(F.col("reason") != "dangling_thread_parent", F.col("inferred_epoch"))
    return found.withColumn("inferred_epoch", stated)


@query("gap_links", "SELECT phantom AS phantom_key, side, artifact AS artifact_key FROM glinks")
def gap_links(v: Views) -> DataFrame:
    return L.gap_links(v.gaps.nodes, v.gaps.edges.kept)


@query(
    "gap_listing",
    """SELECT phantom AS phantom_key, reason, pos AS window_position, count(*) OVER () AS total_findings,
              CAST(sum(CASE WHEN pos = 'in_window' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS in_window,
              CAST(sum(CASE WHEN pos = 'export_boundary' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS at_boundary
       FROM gaprows ORDER BY reason = 'dangling_thread_parent', pos = 'export_boundary', coalesce(days, 0) DESC, phantom LIMIT 100""",
)
def gap_listing(v: Views) -> DataFrame:
    found = L.gap_listing(v.gap_findings)
    return found.select(
        "phantom_key", "reason", "window_position", "total_findings", "in_window", "at_boundary"
    )


@query(
    "gap_chain",
    """WITH c AS (SELECT contract, max(CASE WHEN r = 1 THEN key END) AS b, max(CASE WHEN r = n THEN key END) AS a,
                  string_agg(key, '>' ORDER BY place DESC) AS path,
                  string_agg(CASE WHEN NOT present THEN CAST(n - r AS VARCHAR) END, ',' ORDER BY place DESC) AS idx
             FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY place) AS r, count(*) OVER (PARTITION BY contract) AS n
                   FROM kept WHERE contract IN (SELECT contract FROM kept WHERE NOT present)) GROUP BY contract)
       SELECT a, b, path, idx AS phantom_indices FROM c""",
)
def gap_chain(v: Views) -> DataFrame:
    """Chains from the last to the first kept step of every broken contract."""
    edges = v.gaps.edges.kept.where("rel_type = 'PRECEDED_BY'")
    later = edges.select("props.contract_id", F.col("source_key").alias("k"))
    earlier = edges.select("props.contract_id", F.col("target_key").alias("k"))
    a = later.join(earlier, ["contract_id", "k"], "left_anti").select("contract_id", F.col("k").alias("a"))
    b = earlier.join(later, ["contract_id", "k"], "left_anti").select("contract_id", F.col("k").alias("b"))
    chains = L.gap_chains(v.gaps.nodes, edges, a.join(b, "contract_id"))
    return chains.select(
        "a", "b", F.array_join("path", ">").alias("path"), F.array_join("phantom_indices", ",").alias("phantom_indices")
    )


@query(
    "gap_paths",
    """SELECT x.phantom AS phantom_key FROM glinks x JOIN glinks y ON y.phantom = x.phantom
       WHERE x.side = 'successor' AND x.artifact = 'artifact:slack:c3-1704330000.000100'
         AND y.side = 'predecessor' AND y.artifact = 'artifact:slack:c3-1704326400.000100'""",
)
def gap_paths(v: Views) -> DataFrame:
    """Phantoms between the first two turns of one conversation."""
    links = L.gap_links(v.gaps.nodes, v.gaps.edges.kept)
    day = 1704067200 + 3 * 86400
    return L.gaps_between(
        links, f"artifact:slack:c3-{day + 3600}.000100", f"artifact:slack:c3-{day}.000100"
    )


@query(
    "evidence_enrich",
    """SELECT key AS finding_key, 1 AS position, 'directory_person' AS predicate, id AS source_record_id FROM people
       UNION ALL SELECT key, 1, 'gap_phantom', contract FROM kept WHERE NOT present""",
)
def evidence_enrich(v: Views) -> DataFrame:
    """First evidence of every person and every contract phantom."""
    gaps = v.gap_findings.where("reason = 'required_sequence_step_missing'")
    people = v.people_nodes.select("canonical_key")
    cited = L.cite_nodes(people, "canonical_key", v.bundle.node_evidence).unionByName(
        L.cite_nodes(gaps, "phantom_key", v.bundle.node_evidence)
    )
    shown = L.first_evidence(cited, v.bundle.evidence)
    return shown.select("finding_key", "position", "predicate", "source_record_id")


@query("faultline_evidence")
def faultline_evidence(v: Views) -> DataFrame:
    """First four evidence rows per faultline: dependency, then both owners' claims."""
    cited = L.cite_faultlines(
        talk_faultlines(v), v.coordination.of_type("OWNS", "DEPENDS_ON"), v.bundle.links_of("OWNS", "DEPENDS_ON")
    )
    return L.first_evidence(cited, v.bundle.evidence)
