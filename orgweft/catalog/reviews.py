"""Queries over questions, repairs and the risk inbox."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.catalog.lenses import talk_faultlines
from orgweft.catalog.registry import query
from orgweft.catalog.views import DATASET, Views
from orgweft.operators import inbox as B
from orgweft.operators import lenses as L
from orgweft.operators import questions as Q
from orgweft.operators import repairs as R
from orgweft.operators.normalize import union_all
from orgweft.plans.bundle import canonicalize
from orgweft.plans.load import (
    FOLDERS,
    LEDGER,
    batch_hashes,
    compare_ledger,
    edge_rows,
    ledger_rows,
    load,
    loaded_rows,
    node_rows,
    prepare_load,
    verify_load,
    with_batches,
)
from orgweft.plans.report import risk_report
from orgweft.session import Scratch, durable, shared_folder


# --- questions --------------------------------------------------------------


def questions(v: Views) -> DataFrame:
    """Questions about every module, message and contract, and ones outside the known forms."""
    title = F.col("title")
    ask = lambda df, kind, key, *parts: df.select(
        F.concat(F.lit(kind + ":"), key).alias("question_id"), F.concat(*parts).alias("text")
    )
    modules, module = v.module_names, F.col("module")
    messages, message = v.slack_rows, F.col("id")
    contract = F.regexp_replace("contract_id", "^contract:conv-", "")
    return union_all(
        ask(modules, "owner", module, F.lit("  Who owns   "), title, F.lit("?")),
        ask(modules, "now", module, F.lit("who is responsible for "), F.lower(title), F.lit(" now, and why did it change?")),
        ask(modules, "impact", module, F.lit("Which services are impacted if "), module, F.lit(" changes?")),
        ask(messages, "author", message, F.lit("Who wrote slack:"), message, F.lit("?")),
        ask(messages, "reviewer", message, F.lit("Who replied to slack:"), message),
        ask(v.contracts, "approval", contract, F.lit("Who approved approval c"), contract, F.lit("?")),
        ask(modules, "missing", module, F.lit("Who owns the lost "), title, F.lit("?")),
        ask(v.table("region"), "other", F.col("r_name"), F.lit("How big is "), F.col("r_name"), F.lit("?")),
    )


_ASKED = """asked AS (
    SELECT 'owner:' || m AS id, 'owner' AS intent, t AS subject FROM mods
    UNION ALL SELECT 'now:' || m, 'owner', lower(t) FROM mods
    UNION ALL SELECT 'impact:' || m, 'dependency_impact', m FROM mods
    UNION ALL SELECT 'author:' || id, 'author', 'slack:' || id FROM chat
    UNION ALL SELECT 'reviewer:' || id, 'reviewer', 'slack:' || id FROM chat
    UNION ALL SELECT 'approval:' || conv_id, 'approval', 'approval c' || conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT 'missing:' || m, 'owner', 'the lost ' || t FROM mods
    UNION ALL SELECT 'other:' || r_name, 'unsupported', NULL FROM region)"""
_MODS = "mods AS (SELECT m, p_brand AS t FROM brands UNION ALL SELECT m, p_type FROM types)"


@query("question_intent", f"WITH {_MODS}, {_ASKED} SELECT id AS question_id, intent, subject AS subject_text FROM asked")
def question_intent(v: Views) -> DataFrame:
    return Q.classify(questions(v)).select("question_id", "intent", "subject_text")


@query(
    "question_subject",
    f"""WITH {_MODS}
       SELECT p || m AS question_id, 'module:' || m AS subject_key FROM mods, (SELECT unnest(['owner:', 'now:', 'impact:']) AS p)
       UNION ALL SELECT p || id, 'artifact:slack:' || id FROM chat, (SELECT unnest(['author:', 'reviewer:']) AS p)""",
)
def question_subject(v: Views) -> DataFrame:
    return Q.match_subjects(Q.classify(questions(v)), v.bundle.nodes)


_RANKED = """ranked AS (
    SELECT *, (coalesce(vfrom, now) <= now AND coalesce(vuntil, now) >= now) AS active,
           row_number() OVER (PARTITION BY module ORDER BY NOT (coalesce(vfrom, now) <= now AND coalesce(vuntil, now) >= now),
                              authority_rank DESC, coalesce(observed, 0) DESC, confidence DESC, k) AS r FROM owns, now)"""


@query(
    "owner_answer",
    f"""WITH {_MODS}, {_RANKED}
       SELECT p || m AS question_id, p2.name || ' currently owns ' || t || '.' AS answer, 'module:' || m AS subject_key, confidence
       FROM mods JOIN ranked ON module = 'module:' || m AND r = 1 JOIN people p2 ON p2.key = owner,
            (SELECT unnest(['owner:', 'now:']) AS p)""",
)
def owner_answer(v: Views) -> DataFrame:
    answers = Q.answer_questions(v.answering, questions(v), v.observed).answers
    return answers.where("intent = 'owner' AND status = 'answered'").select(
        "question_id", "answer", "subject_key", "confidence"
    )


@query(
    "owner_decisions",
    f"""WITH {_RANKED}
       SELECT module AS module_key, k AS edge_key, owner AS person_key, authority, confidence, r = 1 AS selected,
              CASE WHEN r = 1 THEN 'Selected: active record with the strongest declared authority.'
                   WHEN NOT active THEN 'Not selected: its validity window ended before the active snapshot.'
                   ELSE 'Not selected: a higher-authority active record exists.' END AS reason
       FROM ranked""",
)
def owner_decisions(v: Views) -> DataFrame:
    facts, best = Q.ranked_owners(v.kept("OWNS"), v.observed)
    found = Q.ownership_decisions(facts, best, v.bundle.links_of("OWNS"), v.owner_evidence)
    return found.select("module_key", "edge_key", "person_key", "authority", "confidence", "selected", "reason")


@query(
    "owner_conflicts",
    """SELECT module AS module_key, owner AS person_key FROM asserted
       WHERE module IN (SELECT module FROM asserted GROUP BY module HAVING count(DISTINCT owner) > 1)""",
)
def owner_conflicts(v: Views) -> DataFrame:
    facts, best = Q.ranked_owners(v.kept("OWNS"), v.observed)
    found = Q.ownership_decisions(facts, best, v.bundle.links_of("OWNS"), v.owner_evidence)
    return Q.conflicts_of(found).select("module_key", "person_key")


@query(
    "author_answer",
    """SELECT 'author:' || id AS question_id, name || ' authored slack:' || c.id || '.' AS answer, 'person:' || author AS person_key
       FROM (SELECT id, author FROM chat) c JOIN (SELECT key, name FROM people) ON key = 'person:' || author""",
)
def author_answer(v: Views) -> DataFrame:
    found = Q.answer_questions(v.answering, questions(v), v.observed)
    return found.answers.where("intent = 'author'").select("question_id", "answer").join(
        found.people.select("question_id", "person_key"), "question_id"
    )


@query(
    "reviewer_answer",
    """SELECT DISTINCT 'reviewer:' || p.id AS question_id, 'person:' || c.author AS person_key,
              'person:' || c.author || '>artifact:slack:' || c.id || '>artifact:slack:' || p.id AS path
       FROM chat c JOIN chat p ON p.id = c.parent""",
)
def reviewer_answer(v: Views) -> DataFrame:
    subjects = Q.match_subjects(Q.classify(questions(v)).where("intent = 'reviewer'"), v.bundle.nodes)
    matches, _cited = Q.reviewer_matches(subjects, v.bundle.edges, v.bundle.edge_evidence)
    return matches.select("question_id", "person_key", F.array_join("path", ">").alias("path"))


@query(
    "impact_answer",
    f"""WITH {_MODS}, {_RANKED}
       SELECT 'impact:' || m AS question_id, d.a AS module_key, r.owner AS person_key, least(100, r.confidence) AS confidence
       FROM mods JOIN depends d ON d.b = 'module:' || m JOIN ranked r ON r.module = d.a AND r.r = 1""",
)
def impact_answer(v: Views) -> DataFrame:
    subjects = Q.match_subjects(Q.classify(questions(v)).where("intent = 'dependency_impact'"), v.bundle.nodes)
    _facts, best = Q.ranked_owners(v.kept("OWNS"), v.observed)
    matches, _cited = Q.impact_matches(subjects, v.kept("DEPENDS_ON"), best, v.bundle.links_of("OWNS", "DEPENDS_ON"))
    return matches.select("question_id", "module_key", "person_key", "confidence")


@query(
    "approval_answer",
    """WITH q AS (SELECT DISTINCT conv_id, 'approval c' || conv_id AS needle FROM conversations),
            k AS (SELECT key, trim(regexp_replace(lower(key), '[^a-z0-9]+', ' ', 'g')) AS t
                  FROM (SELECT key FROM artifacts UNION SELECT phantom FROM gapfind))
       SELECT 'approval:' || conv_id AS question_id, min(key) AS subject_key
       FROM q JOIN k ON contains(t, needle) OR contains(needle, t) GROUP BY conv_id""",
)
def approval_answer(v: Views) -> DataFrame:
    return Q.approval_subjects(Q.classify(questions(v)), v.bundle.nodes)


@query(
    "verdict",
    f"""WITH {_MODS}, {_ASKED}, imp AS (SELECT DISTINCT 'impact:' || m AS id FROM mods JOIN depends d ON d.b = 'module:' || m),
            rev AS (SELECT DISTINCT 'reviewer:' || p.id AS id FROM chat c JOIN chat p ON p.id = c.parent), {_RANKED},
            open AS (SELECT substr(module, 8) AS m FROM ranked WHERE r = 1 AND authority = 'inferred_authorship'
                     AND module IN (SELECT module FROM asserted GROUP BY module HAVING count(DISTINCT owner) > 1))
       SELECT id AS question_id, CASE
         WHEN intent = 'owner' AND substr(id, instr(id, ':') + 1) IN (SELECT m FROM open) AND id NOT LIKE 'missing:%' THEN 'DISPUTED'
         WHEN id LIKE 'missing:%' THEN 'NOT_FOUND'
         WHEN intent IN ('owner', 'author') THEN 'SUPPORTED'
         WHEN intent = 'dependency_impact' AND id IN (SELECT id FROM imp) THEN 'SUPPORTED'
         WHEN intent = 'reviewer' AND id IN (SELECT id FROM rev) THEN 'SUPPORTED'
         ELSE 'UNKNOWN' END AS verdict FROM asked""",
)
def verdict(v: Views) -> DataFrame:
    found = Q.answer_questions(v.answering, questions(v), v.observed)
    return Q.verdicts(found.answers, found.conflicts)


@query(
    "relation_owners",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY NOT (now BETWEEN coalesce(vfrom, 0) AND coalesce(vuntil, now)),
                  authority_rank DESC, coalesce(observed, 0) DESC, confidence DESC, k) AS j FROM owns, now)
       SELECT module AS subject_key, owner AS person_key, confidence FROM b WHERE j = 1""",
)
def relation_owners(v: Views) -> DataFrame:
    rows = Q.relation_rows(v.bundle.edges, "OWNS", limit=None)
    return Q.owners_from_relations(rows, L.snapshot_epoch(v.bundle.evidence)).select(
        "subject_key", "person_key", "confidence"
    )


# --- repairs ----------------------------------------------------------------


_PROPOSED = """prop AS (SELECT 'repair:gap:' || phantom AS repair_id, 'gap' AS finding_kind, phantom AS finding_key, 'record_missing_approval' AS repair_kind,
                    CASE WHEN preds > 0 AND succs > 0 THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS verdict FROM gaprows
             UNION ALL SELECT DISTINCT 'repair:faultline:' || sm || '|' || tm || '|' || so || '|' || t_o, 'faultline', sm || '|' || tm || '|' || so || '|' || t_o,
                    CASE WHEN distance IS NULL THEN 'establish_owner_bridge' ELSE 'add_backup_owner' END,
                    CASE WHEN distance IS NULL THEN 'SUPPORTED' ELSE 'UNKNOWN' END FROM faults)"""
# Talk with the approved bridges in it: a faultline closes when its owners come close enough.
_BRIDGED = """bridged AS (SELECT src, dst FROM arcs UNION SELECT so, t_o FROM faults WHERE distance IS NULL
                          UNION SELECT t_o, so FROM faults WHERE distance IS NULL),
    near AS (SELECT DISTINCT x.src AS a, y.dst AS b FROM (SELECT src, dst FROM bridged UNION SELECT src, src FROM bridged) x
             JOIN (SELECT src, dst FROM bridged UNION SELECT src, src FROM bridged) y ON y.src = x.dst)"""


def proposals(v: Views) -> DataFrame:
    return R.propose_repairs(v.gap_findings, talk_faultlines(v))


@query("repair_proposals", f"WITH {_PROPOSED} SELECT repair_id, finding_kind, finding_key, repair_kind, verdict FROM prop")
def repair_proposals(v: Views) -> DataFrame:
    return proposals(v).select("repair_id", "finding_kind", "finding_key", "repair_kind", "verdict")


@query(
    "repair_verify",
    f"""WITH {_PROPOSED}, {_BRIDGED}, shut AS (SELECT DISTINCT sm || '|' || tm || '|' || so || '|' || t_o AS finding_key FROM faults JOIN near ON a = so AND b = t_o)
       SELECT repair_id, finding_key LIKE 'artifact:approval-%' OR finding_key IN (SELECT finding_key FROM shut) AS closed FROM prop""",
)
def repair_verify(v: Views) -> DataFrame:
    """Approve contract gaps and owner bridges, lay them over, look again."""
    proposed = durable(proposals(v))
    approved = proposed.where(
        "repair_kind = 'establish_owner_bridge' OR finding_key LIKE 'artifact:approval-%'"
    )
    repaired = R.apply_repairs(v.coordination, approved)
    return R.verify_repairs(proposed, R.open_findings(repaired)).select("repair_id", "closed")


@query(
    "repair_ledger",
    f"""WITH {_PROPOSED}
       SELECT repair_id, finding_kind, repair_kind,
              CASE WHEN finding_kind = 'faultline' THEN 'approved' ELSE 'proposed' END AS status, finding_kind = 'faultline' AS closed FROM prop
       UNION ALL SELECT 'repair:gap:' || key, 'gap', 'record_missing_approval', 'rejected', FALSE FROM people WHERE unresolved""",
)
def repair_ledger(v: Views) -> DataFrame:
    """A ledger with decisions on the faultlines and on findings that are gone."""
    proposed = durable(proposals(v))
    decided = proposed.where("finding_kind = 'faultline'").select(
        "repair_id", "finding_kind", "finding_key", "repair_kind", F.lit("approved").alias("status"), F.lit(True).alias("closed")
    )
    old = v.people_nodes.where("props.identity_status = 'unresolved'").select(
        F.concat(F.lit("repair:gap:"), F.col("canonical_key")).alias("repair_id"),
        F.lit("gap").alias("finding_kind"),
        F.col("canonical_key").alias("finding_key"),
        F.lit("record_missing_approval").alias("repair_kind"),
        F.lit("rejected").alias("status"),
        F.lit(False).alias("closed"),
    )
    return R.with_ledger(proposed, decided.unionByName(old)).drop("finding_key")


# --- risk inbox -------------------------------------------------------------


def risks(v: Views, talk: DataFrame | None = None) -> DataFrame:
    """The inbox; people are scored on the conversations' talk, or on the given one."""
    scores = L.ghost_scores(v.people_nodes, v.chat_edges if talk is None else talk)
    return B.risk_inbox(scores, talk_faultlines(v), v.gap_findings)


@query("risk_inbox", "SELECT risk_key, priority, kind, team, confidence, source_key, target_key FROM risks")
def risk_inbox(v: Views) -> DataFrame:
    return risks(v).select("risk_key", "priority", "kind", "team", "confidence", "source_key", "target_key")


@query(
    "inbox_filter",
    """SELECT risk_key, priority, kind, confidence FROM full_risks WHERE priority IN ('P1', 'P2') AND confidence >= 50
       ORDER BY priority, confidence DESC, risk_key LIMIT 25""",
)
def inbox_filter(v: Views) -> DataFrame:
    kept = B.filter_inbox(risks(v, v.full_edges), priorities="P1-P2", confidence="high-medium")
    return B.first_risks(kept).select("risk_key", "priority", "kind", "confidence")


@query(
    "top_nodes",
    """WITH nd AS (SELECT key, CAST(greatest(20, least(82, round_even(20 + c * 250 + degree * 3, 0))) AS BIGINT) AS size FROM scores
                   ORDER BY size DESC, key LIMIT 520)
       SELECT key AS node_key, size AS actual_size, (SELECT count(*) FROM chat_edges WHERE a IN (SELECT key FROM nd) AND b IN (SELECT key FROM nd)) AS edges
       FROM nd""",
)
def top_nodes(v: Views) -> DataFrame:
    nodes = L.graph_nodes(v.people_nodes, L.ghost_scores(v.people_nodes, v.chat_edges))
    shown, among = B.largest_nodes(nodes, L.graph_edges(v.people_nodes, v.chat_edges))
    return shown.select("node_key", "actual_size", among.select(F.count("*")).scalar().alias("edges"))


@query(
    "node_risk",
    """WITH e AS (SELECT source_key AS node, kind, priority, confidence, risk_key FROM risks WHERE source_key IS NOT NULL
                  UNION ALL SELECT target_key, kind, priority, confidence, risk_key FROM risks WHERE target_key IS NOT NULL),
            l AS (SELECT node, arg_max(kind, (priority, -confidence, risk_key)) AS kind FROM e GROUP BY node)
       SELECT s.key AS node_key, CASE l.kind WHEN 'key-person' THEN 'ghost' WHEN 'coordination' THEN 'faultline' ELSE 'none' END AS role
       FROM scores s LEFT JOIN l ON l.node = s.key WHERE lower(s.name) LIKE '%supplier#00000000%'""",
)
def node_risk(v: Views) -> DataFrame:
    nodes = L.graph_nodes(v.people_nodes, L.ghost_scores(v.people_nodes, v.chat_edges))
    return B.node_risks(nodes, risks(v), search=" Supplier#00000000 ").select("node_key", "role")


# --- load and report --------------------------------------------------------


_LOAD_SHAPES = """r AS (SELECT 'nodes' AS stage, 'Person' AS shape, count(*) AS n FROM people UNION ALL SELECT 'nodes', 'Team', count(*) FROM nation
                  UNION ALL SELECT 'nodes', 'Module', (SELECT count(*) FROM brands) + (SELECT count(*) FROM types)
                  UNION ALL SELECT 'nodes', 'Artifact', count(*) FROM commits
                  UNION ALL SELECT 'edges', 'REPORTS_TO|Person|Person', count(*) FROM reporting
                  UNION ALL SELECT 'edges', 'AUTHORED|Person|Artifact', count(*) FROM commits
                  UNION ALL SELECT 'edges', 'ABOUT|Artifact|Module', count(*) FROM commit_modules)"""


@query(
    "load_batches",
    f"""WITH {_LOAD_SHAPES}
       SELECT stage, shape, CAST(b AS BIGINT) AS batch, CAST(least(500, n - b * 500) AS BIGINT) AS n, 'pending' AS state
       FROM r, LATERAL (SELECT unnest(range(CAST(ceil(n / 500.0) AS BIGINT))) AS b)""",
)
def load_batches(v: Views) -> DataFrame:
    """Batches of the directory and commit graph, compared with an empty ledger."""
    base = canonicalize(union_all(v.directory, v.artifact_records), DATASET)
    rows = node_rows(base.nodes, DATASET).unionByName(edge_rows(base.edges, base.nodes, DATASET))
    ledger = v.spark.createDataFrame([], LEDGER)
    states = compare_ledger(batch_hashes(with_batches(rows)), ledger, "bench")
    return states.select("stage", "shape", "batch", "n", "state")


@query(
    "load_resume",
    f"""WITH {_LOAD_SHAPES}, b AS (SELECT CAST(ceil(n / 500.0) AS BIGINT) AS n FROM r)
       SELECT 'attempted' AS measure, CAST(sum(n) AS BIGINT) AS n FROM b
       UNION ALL SELECT 'resumed by the second', CAST(sum((n + 1) // 2) AS BIGINT) FROM b
       UNION ALL SELECT 'resumed by the third', CAST(sum(n) AS BIGINT) FROM b
       UNION ALL SELECT 'rows', CAST(sum(n) AS BIGINT) FROM r
       UNION ALL SELECT 'ids', CAST(sum(n) AS BIGINT) FROM r
       UNION ALL SELECT 'differences', 0
       UNION ALL SELECT 'refused when changed', 1""",
)
def load_resume(v: Views) -> DataFrame:
    """Load, lose every second entry of the ledger, load twice more, then load something else."""
    base = canonicalize(union_all(v.directory, v.artifact_records), DATASET)
    expected = node_rows(base.nodes, DATASET).unionByName(edge_rows(base.edges, base.nodes, DATASET))
    target, size = shared_folder(v.spark, "load"), {"per_part": 50}
    with Scratch(v.spark) as shelf:
        whole = {"prepared": prepare_load(base, shelf), **size}
        runs = [load(base, "bench", target, **whole)]
        left = shelf.keep(ledger_rows(v.spark, target).where("batch % 2 = 0"), "ledger")
        left.write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{target}/ledger")
        runs += [load(base, "bench", target, **whole), load(base, "bench", target, **whole)]
    later = replace(base, nodes=base.nodes.withColumn("confidence", F.col("confidence") - 1))
    try:
        load(later, "bench", target, **size)
        refused = 0
    except ValueError:
        refused = 1
    loaded = loaded_rows(v.spark, target, "bench")
    counts = loaded.agg(F.count("*").alias("rows"), F.count_distinct("stage", "id").alias("ids")).first()
    found = [
        ("attempted", runs[0]["completed_batches"]),
        ("resumed by the second", runs[1]["resumed_batches"]),
        ("resumed by the third", runs[2]["resumed_batches"]),
        ("rows", counts["rows"]),
        ("ids", counts["ids"]),
        ("differences", verify_load(loaded, expected).count()),
        ("refused when changed", refused),
    ]
    return v.spark.createDataFrame(found, "measure STRING, n BIGINT")


@query("risk_report")
def report(v: Views) -> DataFrame:
    return risk_report(replace(v.coordination, dataset_id=DATASET), "bench:snapshot")
