"""Queries that compare findings with truth, rankings with rankings, answers with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.catalog.graphs import full_graph
from orgweft.catalog.lenses import talk_faultlines
from orgweft.catalog.registry import query
from orgweft.catalog.reviews import _MODS, questions
from orgweft.catalog.views import Views
from orgweft.functions.ranking import global_row_number
from orgweft.operators import evaluate as E
from orgweft.operators import lenses as L
from orgweft.operators import questions as Q
from orgweft.plans.corpus import leader_talk, synthetic_events, synthetic_people, synthetic_talk


@query(
    "precision_recall",
    """WITH f AS (SELECT DISTINCT sm, tm FROM faults), p AS (SELECT DISTINCT 'module:' || a AS sm, 'module:' || b AS tm FROM deps WHERE w >= 5),
            h AS (SELECT count(*) AS n FROM f JOIN p USING (sm, tm))
       SELECT (SELECT count(*) FROM f) AS returned, (SELECT count(*) FROM p) AS planted, n AS true_positive,
              round(n / greatest(1, (SELECT count(*) FROM f)), 6) AS precision, round(n / greatest(1, (SELECT count(*) FROM p)), 6) AS recall FROM h""",
)
def precision_recall(v: Views) -> DataFrame:
    """Module pairs of faultlines against the heavy declared dependencies."""
    found = talk_faultlines(v).select(F.col("source_module_key").alias("a"), F.col("target_module_key").alias("b"))
    planted = v.dependencies.where("meta.weight >= 5").select(
        F.get("subjects", F.lit(0)).alias("a"), F.get("subjects", F.lit(1)).alias("b")
    )
    scored = E.precision_recall(found, planted)
    return scored.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(
    "topk_overlap",
    """WITH r AS (SELECT 'degree' AS run, key, row_number() OVER (ORDER BY degree DESC, key) AS position FROM full_scores
                  UNION ALL SELECT 'formal', key, formal FROM full_scores)
       SELECT run, max(CASE WHEN position = 1 THEN key END) AS top1,
              count(CASE WHEN key IN (SELECT key FROM full_scores WHERE structural <= 10) THEN 1 END) / 10.0::DOUBLE AS overlap
       FROM r WHERE position <= 10 GROUP BY run""",
)
def topk_overlap(v: Views) -> DataFrame:
    """How well degree and rank stand in for betweenness."""
    scores = L.ghost_scores(v.people_nodes, v.full_edges)
    by_degree = global_row_number(
        scores.select("person_key", "communication_degree"),
        [F.desc("communication_degree"), F.asc("person_key")],
        "position",
    ).select(F.lit("degree").alias("run"), F.col("person_key").alias("key"), "position")
    by_rank = scores.select(F.lit("formal"), "person_key", "formal_rank")
    exact = scores.select(F.col("person_key").alias("key"), F.col("structural_rank").alias("position"))
    return E.topk_overlap(by_degree.union(by_rank), exact, 10).drop("top1_hit")


@query(
    "max_len_sweep",
    """WITH l AS (SELECT unnest([2, 3, 4, 5, 6]) AS max_len),
            t AS (SELECT max_len, x.v, sum(x.sigma * y.sigma / z.sigma) / 2 AS tally
                  FROM full_sig z JOIN full_sig x ON x.s = z.s JOIN full_sig y ON y.s = x.v AND y.v = z.v JOIN l ON z.d <= max_len
                  WHERE z.s <> z.v AND x.v <> z.s AND x.v <> z.v AND x.d + y.d = z.d GROUP BY max_len, x.v),
            r AS (SELECT max_len, full_verts.v, row_number() OVER (PARTITION BY max_len ORDER BY round(coalesce(tally, 0), 6) DESC, full_verts.v) AS i
                  FROM full_verts CROSS JOIN l LEFT JOIN t USING (max_len, v)),
            k AS (SELECT * FROM r WHERE i <= 10)
       SELECT max_len, (SELECT count(*) FROM full_dist WHERE s < v AND d <= max_len) AS reachable_pairs,
              max(CASE WHEN i = 1 THEN v END) AS top_1,
              round(count(CASE WHEN v IN (SELECT v FROM k WHERE max_len = 4) THEN 1 END) / 10.0, 3)::DOUBLE AS overlap
       FROM k GROUP BY max_len""",
)
def max_len_sweep(v: Views) -> DataFrame:
    from orgweft.operators.graph import length_sweep

    return length_sweep(full_graph(v), range(2, 7), 10)


@query(
    "corpus_summary",
    """SELECT 'faultline_tier' AS measure, tier AS value, count(*) AS n FROM faults GROUP BY tier
       UNION ALL SELECT 'gap_reason', reason, count(*) FROM gaprows GROUP BY reason
       UNION ALL SELECT 'gap_window', pos, count(*) FROM gaprows GROUP BY pos
       UNION ALL SELECT 'role_rank', CAST(rank AS VARCHAR), count(*) FROM people GROUP BY rank
       UNION ALL SELECT 'identity', CASE WHEN unresolved THEN 'unresolved' ELSE 'resolved' END, count(*) FROM people GROUP BY unresolved
       UNION ALL SELECT 'node_label', 'Person', count(*) FROM people
       UNION ALL SELECT 'node_label', 'Team', count(*) FROM nation
       UNION ALL SELECT 'node_label', 'Module', (SELECT count(*) FROM brands) + (SELECT count(*) FROM types)
       UNION ALL SELECT 'node_label', 'Artifact', count(*) FROM artifacts
       UNION ALL SELECT 'node_label', 'Phantom', count(*) FROM gapfind
       UNION ALL SELECT 'edge_type', 'COMMUNICATES', count(*) FROM chat_edges
       UNION ALL SELECT 'edge_type', 'OWNS', count(*) FROM owns
       UNION ALL SELECT 'edge_type', 'DEPENDS_ON', count(*) FROM depends""",
)
def corpus_summary(v: Views) -> DataFrame:
    counts = E.corpus_counts(
        v.coordination, v.gap_findings, talk_faultlines(v)
    )
    return counts.where("measure <> 'edge_type' OR value IN ('COMMUNICATES', 'OWNS', 'DEPENDS_ON')")


@query("robustness")
def robustness(v: Views) -> DataFrame:
    """The ranking with and without unresolved people."""
    from dataclasses import replace

    bundle = replace(v.coordination, nodes=v.people_nodes, edges=v.chat_edges)
    return E.resolved_robustness(bundle, L.ghost_scores(v.people_nodes, v.chat_edges))


@query(
    "question_eval",
    f"""WITH {_MODS}, c AS (
         SELECT 'direct' AS category, count(*) * 2 AS passed, count(*) * 2 AS total FROM mods
         UNION ALL SELECT 'unanswerable', (SELECT count(*) FROM mods) + (SELECT count(*) FROM region), (SELECT count(*) FROM mods) + (SELECT count(*) FROM region)
         UNION ALL SELECT 'multi_hop', (SELECT count(*) FROM mods WHERE 'module:' || m IN (SELECT b FROM depends)), (SELECT count(*) FROM mods))
       SELECT category, CAST(passed AS BIGINT) AS passed, CAST(total AS BIGINT) AS total, round(passed / total, 4) AS rate FROM c
       UNION ALL SELECT 'all', CAST(sum(passed) AS BIGINT), CAST(sum(total) AS BIGINT), round(sum(passed) / sum(total), 4) FROM c
       UNION ALL SELECT 'evidence_citation', CAST(sum(passed) AS BIGINT), CAST(sum(total) AS BIGINT), round(sum(passed) / sum(total), 4)
         FROM c WHERE category <> 'unanswerable'""",
)
def question_eval(v: Views) -> DataFrame:
    """Owner, impact and unanswerable questions against labels."""
    asked = questions(v)
    group = F.substring_index("question_id", ":", 1)
    category = (
        F.when(group.isin("owner", "now"), F.lit("direct"))
        .when(group == "impact", F.lit("multi_hop"))
        .when(group.isin("missing", "other"), F.lit("unanswerable"))
    )
    found = Q.answer_questions(v.answering, asked.where(category.isNotNull()), v.observed)
    people = found.people.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "person_key"))), lambda x: x["person_key"]).alias(
            "expected_person_keys"
        )
    )
    expected = lambda direct, multi, other: F.when(category == "direct", F.lit(direct)).when(
        category == "multi_hop", F.lit(multi)
    ).otherwise(other)
    status = F.when(group == "missing", F.lit("not_found")).otherwise(F.lit("unsupported"))
    kind = F.when(group == "missing", F.lit("abstention")).otherwise(F.lit("unsupported"))
    labels = (
        asked.select("question_id", category.alias("category"))
        .where("category IS NOT NULL")
        .join(people, "question_id", "left")
        .select(
            "question_id",
            "category",
            "expected_person_keys",
            expected("answered", "answered", status).alias("expected_status"),
            expected("direct", "multi_hop", kind).alias("expected_answer_kind"),
            expected(1, 2, F.lit(0)).alias("minimum_evidence"),
            expected(1, 1, F.lit(0)).alias("minimum_paths"),
            F.lit(0).alias("minimum_conflicts"),
        )
    )
    checks = E.question_checks(found, labels, v.bundle.evidence)
    return E.question_metrics(checks)


@query(
    "sealed_labels",
    """SELECT 'ghost_person_key' AS name, (SELECT key FROM full_scores WHERE structural = 1) AS value
       UNION ALL SELECT 'phantom_key', (SELECT phantom FROM gaprows ORDER BY pos <> 'in_window', coalesce(days, 0) DESC, phantom LIMIT 1)
       UNION ALL SELECT 'faultline_modules', (SELECT sm || '|' || tm FROM faults ORDER BY severity DESC, sm, tm LIMIT 1)
       UNION ALL SELECT 'primary_owner', (SELECT owner FROM owns WHERE module = 'module:brand-2' ORDER BY authority_rank DESC, owner DESC LIMIT 1)""",
)
def sealed_labels(v: Views) -> DataFrame:
    nobody = v.people.select(F.lit(None).cast("string").alias("candidate_id"))
    found = E.sealed_predictions(
        v.bundle,
        L.ghost_scores(v.people_nodes, v.full_edges),
        talk_faultlines(v),
        v.gap_findings,
        nobody,
        "module:brand-2",
    )
    return found.where("name <> 'identity_candidate_id'")


@query(
    "percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
                         count(*) OVER (PARTITION BY event_type) AS n FROM events
                  UNION ALL SELECT 'all', value, row_number() OVER (ORDER BY value), count(*) OVER () FROM events)
       SELECT event_type, max(n) AS samples, quantile_cont(value, 0.5) AS p50, max(CASE WHEN i = ceil(n * 0.95) THEN value END) AS p95
       FROM r GROUP BY event_type""",
)
def percentiles(v: Views) -> DataFrame:
    return E.percentiles(v.table("events"), "event_type", "value")


@query("pairwise_cost", "SELECT count(*) * (count(*) - 1) // 2 AS round_trips FROM people")
def pairwise_cost(v: Views) -> DataFrame:
    return E.pairwise_cost(v.people)


@query(
    "synthetic_org",
    """WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, (SELECT count(*) FROM customer) AS n FROM customer),
            tm AS (SELECT greatest(1, n // 50) AS teams FROM p LIMIT 1),
            talk AS (SELECT 12 AS w FROM p, tm WHERE i % 50 = 0 AND i <> 7 AND i < teams * 50
                     UNION ALL SELECT 3 + (i % 50) % 5 FROM p, tm WHERE i % 50 > 0 AND i < teams * 50
                     UNION ALL SELECT 1 FROM p, tm WHERE i % 50 > 0 AND i % 2 = 0 AND i < least((i // 50) * 50 + 50, n) - 1 AND i < teams * 50
                     UNION ALL SELECT unnest([9, 8, 7, 6]))
       SELECT 'people' AS what, count(*) AS n, CAST(sum(CASE WHEN i = 0 THEN 6 WHEN i % 50 = 0 THEN 4 WHEN i = 7 THEN 2 WHEN i % 25 = 12 THEN 3
              WHEN i % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS total FROM p
       UNION ALL SELECT 'talk', count(*), CAST(sum(w) AS BIGINT) FROM talk""",
)
def synthetic(v: Views) -> DataFrame:
    """The planted organisation laid over all customers: one person each."""
    customers = v.table("customer").select("c_custkey")
    people = global_row_number(customers, [F.col("c_custkey")], "place").select((F.col("place") - 1).alias("index"))
    teams = max(1, customers.count() // 50)
    persons = synthetic_people(people, teams)
    talk = synthetic_events(synthetic_talk(people, teams, 7))
    return persons.agg(F.count("*").alias("n"), F.sum("meta.role_rank").alias("total")).select(
        F.lit("people").alias("what"), "n", "total"
    ).unionByName(
        talk.agg(F.count("*").alias("n"), F.sum("meta.interaction_count").alias("total")).select(
            F.lit("talk").alias("what"), "n", "total"
        )
    )


@query(
    "leader_talk",
    """WITH x AS (SELECT p_partkey % n AS i, (p_partkey * 3 + 1) % n AS j, p_size % n AS k FROM part, n),
            t AS (SELECT 's' || i AS a, 's' || j AS b FROM x UNION SELECT 's' || i, 's' || k FROM x
                  UNION SELECT 's' || j, 's' || k FROM x UNION SELECT 'bridge', 's' || i FROM x)
       SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM t WHERE a <> b""",
)
def leaders(v: Views) -> DataFrame:
    """Talk among the three leaders each part has in its row, the first of them its chair."""
    key = F.col("p_partkey")
    groups = v.table("part").select(
        key.alias("place"),
        F.concat(F.lit("part-"), key.cast("string")).alias("slug"),
        F.array(v.handle(key), v.handle(key * 3 + 1), v.handle(F.col("p_size"))).alias("members"),
        F.array(v.handle(key)).alias("chairs"),
    )
    nothing = v.spark.createDataFrame([], "place BIGINT, src STRING, dst STRING, weight INT")
    talk = leader_talk(groups, nothing, "bridge")
    a, b = F.col("meta.sender_external_id"), F.col("meta.recipient_external_id")
    return talk.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
