"""Queries over the communication graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.catalog.registry import VIEWS, query
from orgweft.catalog.views import Views
from orgweft.operators import graph as G
from orgweft.operators import lenses as L


def talk_graph(v: Views) -> G.Graph:
    return G.communication_graph(v.people_nodes, v.chat_edges)


def full_graph(v: Views) -> G.Graph:
    """The graph of all talk, that of every mention among it."""
    return G.communication_graph(v.people_nodes, v.full_edges)


def reporting_pairs(v: Views) -> DataFrame:
    """(person, manager) pairs."""
    managed = v.people.where("meta.manager_external_id IS NOT NULL")
    return managed.select(
        F.concat(F.lit("person:"), F.col("external_id")).alias("a"),
        F.concat(F.lit("person:"), F.col("meta.manager_external_id")).alias("b"),
    )


@query("communication_graph", "SELECT src, dst FROM full_arcs")
def communication_arcs(v: Views) -> DataFrame:
    return full_graph(v).named_arcs


@query("directed_graph", "SELECT a AS source_key, b AS target_key, weight FROM comm_edges")
def directed(v: Views) -> DataFrame:
    return G.directed_communication(v.people_nodes, v.talk_edges)


@query(
    "comm_window",
    "SELECT a AS source_key, b AS target_key, weight, last_epoch FROM recent",
)
def comm_window(v: Views) -> DataFrame:
    return v.recent_talk.select(
        "source_key", "target_key", F.col("props.weight").alias("weight"), F.col("props.last_epoch").alias("last_epoch")
    )


@query(
    "asymmetry",
    """WITH f AS (SELECT a AS person, reply_weight AS sent, 0 AS got FROM comm_edges WHERE reply_weight > 0
                  UNION ALL SELECT b, 0, reply_weight FROM comm_edges WHERE reply_weight > 0),
            s AS (SELECT person, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(got) AS BIGINT) AS got FROM f GROUP BY person)
       SELECT person AS person_key, name AS display_name, sent AS replies_sent, got AS replies_received,
              round(greatest(sent, got) / greatest(1, least(sent, got)), 6) AS imbalance_ratio,
              CASE WHEN sent > got THEN 'mostly_sends' ELSE 'mostly_receives' END AS direction
       FROM s JOIN people ON key = person
       WHERE greatest(sent, got) >= 3 AND greatest(sent, got) / greatest(1, least(sent, got)) >= 1.05""",
)
def asymmetry(v: Views) -> DataFrame:
    found = L.asymmetries(v.people_nodes, v.talk_edges, min_ratio=1.05)
    return found.withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


@query("betweenness_exact", "SELECT v, round(c, 6) AS centrality FROM full_exact")
def betweenness_exact(v: Views) -> DataFrame:
    return G.betweenness_exact(full_graph(v)).select("v", F.round("centrality", 6).alias("centrality"))


@query(
    "betweenness_bounded",
    """WITH t AS (SELECT x.v, sum(x.sigma * y.sigma / z.sigma) AS tally
                  FROM sig z JOIN sig x ON x.s = z.s JOIN sig y ON y.s = x.v AND y.v = z.v
                  WHERE z.s <> z.v AND x.v <> z.s AND x.v <> z.v AND x.d + y.d = z.d AND z.d <= 4
                        AND z.s IN (SELECT key FROM resolved) GROUP BY x.v),
            p AS (SELECT count(*) AS pairs FROM (SELECT DISTINCT least(s, v), greatest(s, v) FROM dist
                  WHERE d BETWEEN 1 AND 4 AND s IN (SELECT key FROM resolved)))
       SELECT verts.v, round(coalesce(tally, 0) / 2 / greatest(pairs, 1), 6) AS centrality
       FROM verts LEFT JOIN t ON t.v = verts.v, p""",
)
def betweenness_bounded(v: Views) -> DataFrame:
    sources = G.resolved_people(v.people_nodes).select(F.lit("").alias("g"), F.col("canonical_key").alias("s"))
    scores = G.betweenness_bounded(talk_graph(v), sources, 4)
    return scores.select("v", F.round("centrality", 6).alias("centrality"))


def _sampled(seed: int, size: int) -> str:
    """SQL parts whose last, ``sampled``, has the drawn pairs of vertices (a < b)."""
    return f"""
        numbered AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM verts),
        total AS (SELECT count(*) * (count(*) - 1) // 2 AS total,
                         CAST(ceil(sqrt(count(*) * (count(*) - 1) // 2)) AS BIGINT) AS side FROM verts),
        draw AS (SELECT 0 AS round, x.range // side AS high, x.range % side AS low
                 FROM range({size}) x, total WHERE x.range < total
                 UNION ALL
                 SELECT round % 4 + 1, low,
                        (high + CAST('0x' || substr(sha256('{seed}:' || round % 4 || ':' || low), 1, 15) AS BIGINT)) % side
                 FROM draw, total WHERE round < 4 OR high * side + low >= total),
        number AS (SELECT high * side + low AS number FROM draw, total WHERE round = 4 AND high * side + low < total),
        sampled AS (SELECT x.v AS a, y.v AS b FROM number JOIN numbered y ON y.i * (y.i - 1) // 2 <= number
                        AND number < y.i * (y.i + 1) // 2
                    JOIN numbered x ON x.i = number - y.i * (y.i - 1) // 2)"""


@query(
    "betweenness_sampled",
    f"""WITH {_sampled(11, 2000)},
            firsts AS (SELECT DISTINCT a AS s, a AS v, [a] AS path, 0 AS d FROM sampled
                       UNION ALL
                       SELECT p.s, a.dst, min(list_append(p.path, a.dst)), p.d + 1 FROM firsts p JOIN arcs a ON a.src = p.v
                       JOIN dist t ON t.s = p.s AND t.v = a.dst AND t.d = p.d + 1 WHERE p.d < 4 GROUP BY p.s, a.dst, p.d),
            found AS (SELECT path FROM sampled x JOIN firsts p ON p.s = x.a AND p.v = x.b),
            tallies AS (SELECT v, count(*) AS tally FROM (SELECT unnest(path[2:-2]) AS v FROM found) GROUP BY v)
       SELECT verts.v, coalesce(tally, 0) AS tally,
              coalesce(tally, 0) / greatest((SELECT count(*) FROM found), 1) AS score
       FROM verts LEFT JOIN tallies t ON t.v = verts.v""",
)
def betweenness_sampled(v: Views) -> DataFrame:
    return G.betweenness_sampled(talk_graph(v), 11, 2000)


@query("pair_sample", f"WITH {_sampled(29, 2000)} SELECT a, b FROM sampled")
def pair_sample(v: Views) -> DataFrame:
    return G.sampled_pairs(talk_graph(v), 29, 2000)


@query(
    "ghost",
    """SELECT key AS person_key, name AS display_name, rank AS role_rank, structural AS structural_rank,
              formal AS formal_rank, formal - structural AS rank_gap, round(c, 6) AS sampled_centrality,
              degree AS communication_degree FROM scores""",
)
def ghost(v: Views) -> DataFrame:
    scores = L.ghost_scores(v.people_nodes, v.chat_edges).drop("centrality_method")
    return scores.withColumn("sampled_centrality", F.round("sampled_centrality", 6))


@query(
    "ghost_bounded",
    """WITH r AS (SELECT p.key, p.name, p.rank, c, coalesce(degree, 0) AS degree,
                    row_number() OVER (ORDER BY c DESC, p.key) AS structural,
                    row_number() OVER (ORDER BY p.rank DESC, p.key) AS formal
             FROM resolved p JOIN bounded e ON e.v = p.key LEFT JOIN degree d ON d.v = p.key)
       SELECT key AS person_key, name AS display_name, rank AS role_rank, structural AS structural_rank,
              formal AS formal_rank, formal - structural AS rank_gap, round(c, 6) AS sampled_centrality,
              degree AS communication_degree FROM r""",
)
def ghost_bounded(v: Views) -> DataFrame:
    scores = L.ghost_scores(v.people_nodes, v.chat_edges, method="bounded").drop("centrality_method")
    return scores.withColumn("sampled_centrality", F.round("sampled_centrality", 6))


@query(
    "distances",
    """SELECT DISTINCT least(so, t_o) AS a, greatest(so, t_o) AS b, distance FROM lines""",
)
def distances(v: Views) -> DataFrame:
    """Distances of all owner pairs of dependent modules."""
    owners = L.effective_owners(v.kept("OWNS"), v.observed)
    pairs = L.owner_pairs(v.kept("DEPENDS_ON"), owners).select(
        F.col("source_owner_key").alias("a"), F.col("target_owner_key").alias("b")
    )
    return G.pair_distances(talk_graph(v), pairs, 4)


@query(
    "bridge",
    """SELECT a, b, array_to_string(min(path), '>') AS path FROM reporting
       LEFT JOIN allpaths p ON p.s = a AND p.v = b GROUP BY a, b""",
)
def bridge(v: Views) -> DataFrame:
    found = G.first_bridges(talk_graph(v), reporting_pairs(v))
    return found.select("a", "b", F.array_join("path", ">").alias("path"))


@query(
    "all_paths",
    "SELECT a, b, array_to_string(path, '>') AS path FROM reporting JOIN allpaths p ON p.s = a AND p.v = b",
)
def all_paths(v: Views) -> DataFrame:
    found = G.all_shortest_paths(talk_graph(v), reporting_pairs(v), 4)
    return found.select("a", "b", F.array_join("path", ">").alias("path"))


@query("reachable_pairs", "SELECT count(*) AS pairs FROM full_dist WHERE s < v AND d <= 4")
def reachable_pairs(v: Views) -> DataFrame:
    return G.reachable_pairs(full_graph(v), 4).select("pairs")


@query(
    "bus_factor",
    """WITH bwalks AS (SELECT v AS s, v, 0 AS d FROM full_verts WHERE v <> 'person:s7'
              UNION SELECT w.s, a.dst, w.d + 1 FROM bwalks w JOIN full_arcs a ON a.src = w.v AND a.dst <> 'person:s7' WHERE w.d < 4),
            x AS (SELECT count(*) AS n FROM full_dist WHERE s < v AND d <= 4 AND s <> 'person:s7' AND v <> 'person:s7'),
            y AS (SELECT count(*) AS n FROM (SELECT DISTINCT s, v FROM bwalks WHERE s < v))
       SELECT 'person:s7' AS person_key, x.n AS reachable_pairs_before, x.n - y.n AS pairs_lost_without_person, 4 AS max_len FROM x, y""",
)
def bus_factor(v: Views) -> DataFrame:
    return L.bus_factor(full_graph(v), "person:s7")


@query(
    "removal_top10",
    """WITH n4 AS (SELECT count(*) AS n FROM full_dist WHERE s < v AND d <= 4),
            r AS (SELECT g, count(*) AS m FROM (SELECT DISTINCT g, s, v FROM full_removedwalks WHERE s < v) GROUP BY g)
       SELECT key AS person_key, structural AS structural_rank, n AS reachable_pairs_before,
              n - coalesce(m, 0) AS pairs_lost_without_person
       FROM full_scores LEFT JOIN r ON g = key, n4 WHERE structural <= 10""",
)
def removal_top10(v: Views) -> DataFrame:
    found = L.ghost_findings(v.people_nodes, v.full_edges).where("pairs_lost_without_person IS NOT NULL")
    return found.select("person_key", "structural_rank", "reachable_pairs_before", "pairs_lost_without_person")


@query(
    "what_if",
    """WITH gone AS (SELECT key FROM people WHERE rank = 6),
            keep AS (SELECT src, dst FROM full_arcs WHERE src NOT IN (SELECT key FROM gone) AND dst NOT IN (SELECT key FROM gone)),
            gwalks AS (SELECT v AS s, v, 0 AS d FROM full_verts WHERE v NOT IN (SELECT key FROM gone)
              UNION SELECT w.s, a.dst, w.d + 1 FROM gwalks w JOIN keep a ON a.src = w.v WHERE w.d < 4),
            x AS (SELECT count(*) AS n FROM full_dist WHERE s < v AND d <= 4 AND s NOT IN (SELECT key FROM gone) AND v NOT IN (SELECT key FROM gone)),
            y AS (SELECT count(*) AS n FROM (SELECT DISTINCT s, v FROM gwalks WHERE s < v))
       SELECT x.n AS pairs_before, y.n AS pairs_after, x.n - y.n AS pairs_lost, 4 AS max_len FROM x, y""",
)
def what_if(v: Views) -> DataFrame:
    """Take all people of the highest rank out."""
    bundle = v.coordination
    people = v.people_nodes.where("props.role_rank = 6").select(F.col("canonical_key").alias("person_key"))
    from dataclasses import replace

    return L.what_if(replace(bundle, nodes=v.people_nodes, edges=v.full_edges), people)


@query(
    "even_sample",
    """WITH r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM resolved),
            k AS (SELECT least(30, (SELECT count(*) FROM resolved)) AS k),
            p AS (SELECT DISTINCT CAST(round_even(range * ((SELECT count(*) FROM resolved) - 1) / (k - 1), 0) AS BIGINT) AS i
                  FROM k, range(30) WHERE range < k)
       SELECT key AS canonical_key FROM r JOIN p USING (i)""",
)
def even_sample(v: Views) -> DataFrame:
    people = G.resolved_people(v.people_nodes).select("canonical_key")
    return G.even_sample(people, [F.col("canonical_key")], 30)


def _induced(view: str) -> str:
    """A view over the whole graph as one over the arcs ``iarcs`` and vertices ``iverts``."""
    return re.sub(r"\b(walks|dist|sig|between|arcs|verts)\b", r"i\1", VIEWS[view])


@query(
    "sampled_graph",
    f"""WITH r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM resolved),
            k AS (SELECT least(40, (SELECT count(*) FROM resolved)) AS k),
            chosen AS (SELECT DISTINCT key FROM r, k, range(40) x
                       WHERE x.range < k AND i = CAST(round_even(x.range * (n - 1) / (k - 1), 0) AS BIGINT)),
            between_all AS (SELECT s AS a, v, [s] AS path, 0 AS d FROM (SELECT key AS s, key AS v FROM chosen)
                       UNION ALL
                       SELECT p.a, x.dst, list_append(p.path, x.dst), p.d + 1 FROM between_all p JOIN arcs x ON x.src = p.v
                       JOIN dist t ON t.s = p.a AND t.v = x.dst AND t.d = p.d + 1 WHERE p.d < 4),
            shown AS (SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY a, v ORDER BY path) AS place
                       FROM between_all WHERE a < v AND v IN (SELECT key FROM chosen)) WHERE place <= 3),
            hops AS (SELECT path[j] AS src, path[j + 1] AS dst
                       FROM (SELECT path, unnest(range(1, len(path))) AS j FROM shown)),
            bothways AS (SELECT src, dst FROM hops UNION SELECT dst, src FROM hops),
            iarcs AS (SELECT src, dst FROM bothways
                       WHERE src IN (SELECT key FROM resolved) AND dst IN (SELECT key FROM resolved)),
            iverts AS (SELECT DISTINCT v FROM (SELECT unnest(path) AS v FROM shown) WHERE v IN (SELECT key FROM resolved)),
            iwalks AS ({_induced("walks")}), idist AS ({_induced("dist")}), isig AS ({_induced("sig")}),
            ibetween AS ({_induced("between")}), iexact AS ({_induced("exact")}),
            idegree AS (SELECT src AS v, count(*) AS degree FROM bothways GROUP BY src)
       SELECT p.key AS person_key, p.name AS display_name, p.rank AS role_rank,
              row_number() OVER (ORDER BY c DESC, p.key) AS structural_rank,
              row_number() OVER (ORDER BY p.rank DESC, p.key) AS formal_rank,
              row_number() OVER (ORDER BY p.rank DESC, p.key) - row_number() OVER (ORDER BY c DESC, p.key) AS rank_gap,
              round(c, 6) AS sampled_centrality, coalesce(degree, 0) AS communication_degree
       FROM resolved p JOIN iexact e ON e.v = p.key LEFT JOIN idegree d ON d.v = p.key""",
)
def sampled_graph(v: Views) -> DataFrame:
    """Scores on the graph of shortest paths between evenly spaced people."""
    scores = L.sampled_ghosts(v.people_nodes, v.chat_edges, [F.col("canonical_key")], sample=40)
    return scores.drop("centrality_method").withColumn("sampled_centrality", F.round("sampled_centrality", 6))


@query(
    "graph_counts",
    """WITH e AS (SELECT 'Person' AS s, 'COMMUNICATES' AS r, 'Person' AS t, count(*) AS n FROM comm_edges
         UNION ALL SELECT 'Person', 'REPORTS_TO', 'Person', count(*) FROM reporting
         UNION ALL SELECT 'Person', 'AUTHORED', 'Artifact', (SELECT count(*) FROM commits) + (SELECT count(*) FROM chat)
         UNION ALL SELECT 'Artifact', 'ABOUT', 'Module', (SELECT count(*) FROM commit_modules) + (SELECT count(*) FROM chat)
         UNION ALL SELECT 'Person', 'OWNS', 'Module', count(*) FROM owns
         UNION ALL SELECT 'Module', 'DEPENDS_ON', 'Module', count(*) FROM depends
         UNION ALL SELECT 'Artifact', 'REPLIES_TO', 'Artifact', count(*) FROM chat c JOIN chat p ON p.id = c.parent
         UNION ALL SELECT 'Artifact', 'REPLIES_TO', 'Phantom', count(*) FROM dangling
         UNION ALL SELECT CASE WHEN x.present THEN 'Artifact' ELSE 'Phantom' END, 'PRECEDED_BY', CASE WHEN y.present THEN 'Artifact' ELSE 'Phantom' END, count(*)
            FROM preceded p JOIN kept x ON x.key = p.key AND x.contract = p.contract JOIN kept y ON y.key = p.previous AND y.contract = p.contract GROUP BY 1, 3),
       nd AS (SELECT 'Person' AS l, count(*) AS n FROM people UNION ALL SELECT 'Team', count(*) FROM nation
         UNION ALL SELECT 'Module', (SELECT count(*) FROM brands) + (SELECT count(*) FROM types)
         UNION ALL SELECT 'Artifact', count(*) FROM artifacts UNION ALL SELECT 'Phantom', count(*) FROM gapfind)
       SELECT 'nodes' AS what, l AS source_label, '' AS rel_type, '' AS target_label, n FROM nd
       UNION ALL SELECT 'nodes', '*', '', '', CAST(sum(n) AS BIGINT) FROM nd
       UNION ALL SELECT 'edges', s, r, t, n FROM e WHERE n > 0
       UNION ALL SELECT 'edges', '*', '*', '*', CAST(sum(n) AS BIGINT) FROM e""",
)
def graph_counts(v: Views) -> DataFrame:
    return L.graph_counts(v.bundle.nodes, v.bundle.edges)


@query(
    "graph_view",
    """WITH top AS (SELECT key FROM scores WHERE structural <= 10 ORDER BY formal - structural DESC, structural LIMIT 1)
       SELECT p.key AS node_key, p.name,
              CASE WHEN p.rank >= 6 THEN 'VP, ' || x ELSE x || ' ' || CASE p.rank WHEN 0 THEN 'member' WHEN 1 THEN 'engineer'
                   WHEN 2 THEN 'senior engineer' WHEN 3 THEN 'lead' WHEN 4 THEN 'manager' ELSE 'director' END END AS title,
              team, CAST(greatest(20, least(82, 22 + p.rank * 10)) AS BIGINT) AS official_size,
              CAST(greatest(20, least(82, round_even(20 + c * 250 + degree * 3, 0))) AS BIGINT) AS actual_size,
              p.key = (SELECT key FROM top) AS selected
       FROM (SELECT *, 'Nation ' || substr(team, 8) AS x FROM resolved) p JOIN scores s ON s.key = p.key""",
)
def graph_view(v: Views) -> DataFrame:
    return L.graph_nodes(v.people_nodes, L.ghost_scores(v.people_nodes, v.chat_edges))


@query(
    "graph_view_edges",
    """SELECT a AS source, b AS target, CASE WHEN weight >= 5 THEN 'strong' WHEN weight >= 3 THEN 'medium' ELSE 'weak' END AS strength
       FROM full_chat_edges WHERE a IN (SELECT key FROM resolved) AND b IN (SELECT key FROM resolved)""",
)
def graph_view_edges(v: Views) -> DataFrame:
    return L.graph_edges(v.people_nodes, v.full_edges)
