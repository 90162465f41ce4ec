"""Where queries register themselves, and the SQL fragments their checks share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orgweft.catalog.views import Views, open_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(views) -> DataFrame`` with the SQL that gives the same rows."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(open_views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


# --- the bench views in SQL ---------------------------------------------------

BASE = 1704067200

VIEWS: dict[str, str] = {
    "n": "SELECT count(*) AS n FROM supplier",
    "people": """
        SELECT 's' || s_suppkey AS id, 'person:s' || s_suppkey AS key, s_suppkey, s_name AS name,
               s_acctbal, CAST(greatest(0, least(6, floor(s_acctbal / 1500))) AS BIGINT) AS rank,
               'nation-' || s_nationkey AS team, s_acctbal < 0 AS unresolved
        FROM supplier""",
    "resolved": "SELECT * FROM people WHERE NOT unresolved",
    "comm": """
        SELECT 's' || l_suppkey AS a, 's' || (l_partkey % n) AS b, CAST(l_quantity AS BIGINT) AS q,
               CASE l_returnflag WHEN 'R' THEN 'reply' WHEN 'A' THEN 'mention' ELSE 'email' END AS kind,
               CAST(epoch(l_shipdate) AS BIGINT) AS t
        FROM lineitem, n WHERE l_suppkey <> l_partkey % n""",
    "comm_edges": """
        SELECT 'person:' || a AS a, 'person:' || b AS b,
               CAST(sum(CASE WHEN kind = 'mention' THEN q ELSE 0 END) AS BIGINT) AS mention_weight,
               CAST(sum(CASE WHEN kind = 'reply' THEN q ELSE 0 END) AS BIGINT) AS reply_weight,
               CAST(sum(CASE WHEN kind = 'email' THEN q ELSE 0 END) AS BIGINT) AS email_weight,
               CAST(sum(q) AS BIGINT) AS weight, min(t) AS first_epoch, max(t) AS last_epoch
        FROM comm GROUP BY ALL""",
    "recent": """
        SELECT * FROM comm_edges
        WHERE last_epoch >= (SELECT max(last_epoch) FROM comm_edges) - 7 * 86400""",
    # Who talks to whom in the conversations: every reply and every mention.
    "chat_comm": """
        SELECT c.author AS a, p.author AS b, c.t FROM chat c JOIN chat p ON p.id = c.parent WHERE p.author <> c.author
        UNION ALL
        SELECT a, m, t FROM (
            SELECT DISTINCT id, t, author AS a, unnest(regexp_extract_all(text, '<@([^>|]+)', 1)) AS m FROM chat)
        WHERE m <> a""",
    "chat_edges": """
        SELECT 'person:' || a AS a, 'person:' || b AS b, count(*) AS weight, max(t) AS last_epoch
        FROM chat_comm GROUP BY a, b""",
    "arcs": "SELECT a AS src, b AS dst FROM chat_edges UNION SELECT b, a FROM chat_edges",
    "verts": "SELECT key AS v FROM resolved UNION SELECT src FROM arcs",
    # Shortest distances by walks of growing length, kept distinct.
    "walks": """
        SELECT v AS s, v, 0 AS d FROM verts
        UNION
        SELECT w.s, a.dst, w.d + 1 FROM walks w JOIN arcs a ON a.src = w.v WHERE w.d < 24""",
    "dist": "SELECT s, v, min(d) AS d FROM walks GROUP BY s, v",
    "sig": """
        SELECT v AS s, v, 0 AS d, CAST(1 AS DOUBLE) AS sigma FROM verts
        UNION ALL
        SELECT g.s, a.dst AS v, g.d + 1 AS d, sum(g.sigma) AS sigma
        FROM sig g JOIN arcs a ON a.src = g.v
        JOIN dist t ON t.s = g.s AND t.v = a.dst AND t.d = g.d + 1
        GROUP BY g.s, a.dst, g.d""",
    "between": """
        SELECT x.v, sum(x.sigma * y.sigma / z.sigma) AS tally
        FROM sig z JOIN sig x ON x.s = z.s JOIN sig y ON y.s = x.v AND y.v = z.v
        WHERE z.s <> z.v AND x.v <> z.s AND x.v <> z.v AND x.d + y.d = z.d
        GROUP BY x.v""",
    "exact": """
        SELECT verts.v, round(coalesce(tally, 0) /
               ((SELECT count(*) FROM verts) - 1) / ((SELECT count(*) FROM verts) - 2), 12) AS c
        FROM verts LEFT JOIN between ON between.v = verts.v""",
    "bounded": """
        SELECT verts.v, round(coalesce(tally, 0) / 2 / greatest(pairs, 1), 12) AS c
        FROM verts LEFT JOIN (
            SELECT x.v, sum(x.sigma * y.sigma / z.sigma) AS tally
            FROM sig z JOIN sig x ON x.s = z.s JOIN sig y ON y.s = x.v AND y.v = z.v
            WHERE z.s <> z.v AND x.v <> z.s AND x.v <> z.v AND x.d + y.d = z.d AND z.d <= 4
                  AND z.s IN (SELECT key FROM resolved) GROUP BY x.v) t ON t.v = verts.v,
            (SELECT count(*) AS pairs FROM (SELECT DISTINCT least(s, v), greatest(s, v) FROM dist
             WHERE d BETWEEN 1 AND 4 AND s IN (SELECT key FROM resolved)))""",
    "degree": "SELECT src AS v, count(*) AS degree FROM arcs GROUP BY src",
    "scores": """
        SELECT p.key, p.name, p.rank, c, coalesce(degree, 0) AS degree,
               row_number() OVER (ORDER BY c DESC, p.key) AS structural,
               row_number() OVER (ORDER BY p.rank DESC, p.key) AS formal
        FROM resolved p JOIN exact e ON e.v = p.key LEFT JOIN degree d ON d.v = p.key""",
    "brands": "SELECT DISTINCT p_brand, 'brand-' || substr(p_brand, 7) AS m FROM part",
    "types": "SELECT DISTINCT p_type, 'type-' || lower(p_type) AS m FROM part",
    "commit_modules": """
        SELECT DISTINCT 'o' || l_orderkey AS sha, 'brand-' || substr(p_brand, 7) AS m
        FROM lineitem JOIN part ON p_partkey = l_partkey
        JOIN orders ON o_orderkey = l_orderkey""",
    "commits": """
        SELECT 'o' || o_orderkey AS sha, 's' || (o_custkey % n) AS author,
               CAST(epoch(o_orderdate) AS BIGINT) AS t, o_orderpriority AS message
        FROM orders, n""",
    "cochange": """
        SELECT x.sha, x.m AS a, y.m AS b FROM commit_modules x
        JOIN commit_modules y ON y.sha = x.sha AND x.m < y.m""",
    "deps": """
        SELECT 'brand-' || substr(x.p_brand, 7) AS a, 'brand-' || substr(y.p_brand, 7) AS b,
               count(*) AS w
        FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1
        WHERE x.p_brand <> y.p_brand GROUP BY ALL""",
    "asserted": f"""
        SELECT key AS owner, 'module:brand-' || (1 + s_suppkey % 25) AS module, team AS authority,
               rank * 10 AS authority_rank, 50 + s_suppkey % 50 AS confidence,
               789004800 + s_suppkey * 86400 AS observed,
               CASE WHEN s_acctbal <= 5000 THEN 789004800 + s_suppkey * 86400 + 157680000 END AS until,
               'assert-' || id AS rec
        FROM people""",
    "aggregated": """
        SELECT 'person:s' || l_suppkey AS owner, 'module:type-' || lower(p_type) AS module,
               count(*) AS attributed,
               CAST(sum(count(*)) OVER (PARTITION BY p_type) AS BIGINT) AS total
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type""",
    "density": """
        SELECT 'person:' || author AS owner, 'module:' || m AS module, count(*) AS attributed,
               CAST(sum(count(*)) OVER (PARTITION BY m) AS BIGINT) AS total,
               row_number() OVER (PARTITION BY m ORDER BY count(*) DESC, author) AS owner_rank
        FROM (SELECT author, m FROM commit_modules JOIN commits USING (sha)
              UNION ALL SELECT author, m FROM chat) GROUP BY author, m""",
    "owns": """
        SELECT owner, module, 'owns:' || substr(owner, 8) || ':' || substr(module, 8) || ':authorship_density' AS k,
               0 AS authority_rank, 'inferred_authorship' AS authority, NULL AS observed,
               CAST(round_even(attributed * 1.0 / total * 100, 0) AS BIGINT) AS confidence, 1 AS owner_rank,
               NULL AS vfrom, NULL AS vuntil FROM aggregated
        UNION ALL
        SELECT owner, module, 'owns:' || substr(owner, 8) || ':' || substr(module, 8) || ':assertion:' || rec,
               authority_rank, authority, observed, confidence, 1, observed, until FROM asserted
        UNION ALL
        SELECT owner, module, 'owns:' || substr(owner, 8) || ':' || substr(module, 8) || ':authorship_density_derived',
               0, 'inferred_authorship', NULL,
               greatest(1, least(100, CAST(round_even(attributed * 1.0 / total * 100, 0) AS BIGINT))),
               owner_rank, NULL, NULL FROM density WHERE owner_rank <= 3""",
    "now": f"""
        SELECT greatest((SELECT max(t) FROM comm), (SELECT max(t) FROM commits),
               (SELECT max(observed) FROM asserted), (SELECT max(t) FROM chat)) AS now""",
    "best": """
        SELECT module, owner, confidence FROM (
            SELECT *, row_number() OVER (PARTITION BY module ORDER BY authority_rank DESC,
                   coalesce(observed, 0) DESC, confidence DESC, k) AS r
            FROM owns, now WHERE authority_rank > 0 AND now BETWEEN coalesce(vfrom, 0) AND coalesce(vuntil, now))
        WHERE r = 1""",
    "owners": """
        SELECT module, owner, confidence FROM best
        UNION ALL
        SELECT module, owner, confidence FROM owns
        WHERE module NOT IN (SELECT module FROM best) AND (confidence > 50 OR owner_rank = 1)""",
    "depends": """
        SELECT 'module:' || a AS a, 'module:' || b AS b, w,
               'depends_on:' || a || ':' || b || ':import' AS k FROM deps
        UNION ALL
        SELECT 'module:' || a, 'module:' || b, count(*), 'depends_on:' || a || ':' || b || ':cochange'
        FROM cochange GROUP BY a, b""",
    "lines": """
        SELECT k, d.a AS sm, d.b AS tm, w, x.owner AS so, y.owner AS t_o, x.confidence AS sc,
               y.confidence AS tc, t.d AS distance
        FROM depends d JOIN owners x ON x.module = d.a JOIN owners y ON y.module = d.b
        LEFT JOIN dist t ON t.s = x.owner AND t.v = y.owner AND t.d <= 4""",
    "faults": """
        SELECT *, CASE WHEN distance IS NULL THEN 'no_path' ELSE 'weak_coordination' END AS tier,
               w * CASE WHEN distance IS NULL THEN 1.0 ELSE 0.5 END AS severity
        FROM lines WHERE distance IS NULL OR distance >= 3""",
    "chat": f"""
        SELECT conv_id, turn, 'c' || conv_id AS channel, 's' || ((conv_id * 7 + turn) % n) AS author,
               {BASE} + conv_id * 86400 + turn * 3600 AS t,
               'c' || conv_id || '-' || ({BASE} + conv_id * 86400 + turn * 3600) || '.000100' AS id,
               CASE WHEN turn <= 1 THEN 'c' || conv_id || '-' || ({BASE} + conv_id * 86400 - 3600) || '.000100'
                    ELSE 'c' || conv_id || '-' || ({BASE} + conv_id * 86400 + (turn - 1) * 3600) || '.000100'
               END AS parent,
               '<@s' || (CASE WHEN turn % 4 = 0 THEN conv_id ELSE conv_id * 7 + turn END) % n || '> <@s'
                    || ((conv_id * 7 + turn + n - 1) % n) || '|x> ' || text AS text,
               'brand-' || (1 + conv_id % 25) AS m
        FROM conversations, n""",
    "artifacts": """
        SELECT 'artifact:git:' || sha AS key, t FROM commits
        UNION ALL SELECT 'artifact:slack:' || id, t FROM chat""",
    "start": "SELECT min(t) AS start FROM artifacts",
    "dangling": """
        SELECT 'artifact:slack:' || c.id AS child, 'artifact:slack:' || c.parent AS parent, c.t,
               CAST(greatest(0, floor((c.t - start) / 86400.0)) AS BIGINT) AS days
        FROM chat c, start WHERE c.parent NOT IN (SELECT id FROM chat)""",
    "steps": f"""
        SELECT 'contract:conv-' || conv_id AS contract, conv_id, 0 AS place,
               'artifact:slack:c' || conv_id || '-' || ({BASE} + conv_id * 86400) || '.000100' AS key,
               'message' AS kind, TRUE AS required, NULL AS earliest FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT 'contract:conv-' || conv_id, conv_id, 1, 'artifact:approval-c' || conv_id, 'approval', TRUE,
               {BASE} + conv_id * 86400 + 1800 FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT 'contract:conv-' || conv_id, conv_id, 2,
               'artifact:slack:c' || conv_id || '-' || ({BASE} + conv_id * 86400 + 3600) || '.000100', 'message', TRUE,
               NULL FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT 'contract:conv-' || conv_id, conv_id, 3,
               'artifact:slack:c' || conv_id || '-' || ({BASE} + conv_id * 86400 + 25200) || '.000100', 'message', FALSE,
               NULL FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "kept": """
        SELECT s.*, a.key IS NOT NULL AS present FROM steps s LEFT JOIN artifacts a ON a.key = s.key
        WHERE a.key IS NOT NULL OR required""",
    "preceded": """
        SELECT * FROM (
            SELECT contract, key, lag(key) OVER (PARTITION BY contract ORDER BY place) AS previous FROM kept
            WHERE contract IN (SELECT contract FROM kept WHERE NOT present))
        WHERE previous IS NOT NULL""",
    "glinks": """
        SELECT p.key AS phantom, 'predecessor' AS side, previous AS artifact
        FROM preceded JOIN (SELECT DISTINCT key FROM kept WHERE NOT present) p ON p.key = preceded.key
        UNION ALL
        SELECT p.key, 'successor', preceded.key
        FROM preceded JOIN (SELECT DISTINCT key FROM kept WHERE NOT present) p ON p.key = preceded.previous
        UNION ALL
        SELECT parent, 'successor', child FROM dangling""",
    "gapfind": """
        SELECT key AS phantom, kind AS expected, 'required_sequence_step_missing' AS reason, earliest AS stated,
               'unknown' AS pos, CAST(NULL AS BIGINT) AS days FROM (SELECT DISTINCT key, kind, earliest FROM kept WHERE NOT present)
        UNION ALL
        SELECT parent, 'thread_parent', 'dangling_thread_parent', max(t),
               CASE WHEN max(days) <= 30 THEN 'export_boundary' ELSE 'in_window' END, max(days)
        FROM dangling GROUP BY parent""",
    "gapsum": """
        SELECT phantom, count(CASE WHEN side = 'predecessor' THEN 1 END) AS preds,
               count(CASE WHEN side = 'successor' THEN 1 END) AS succs,
               min(CASE WHEN side = 'predecessor' THEN artifact END) AS first_pred,
               min(CASE WHEN side = 'successor' THEN artifact END) AS first_succ,
               max(CASE WHEN side = 'predecessor' THEN a.t END) AS lp,
               min(CASE WHEN side = 'successor' THEN a.t END) AS fs
        FROM glinks LEFT JOIN artifacts a ON a.key = artifact GROUP BY phantom""",
    "gaprows": """
        SELECT f.phantom, expected, reason,
               coalesce(stated, CAST(round_even((lp + fs) / 2.0, 0) AS BIGINT)) AS epoch,
               coalesce(preds, 0) AS preds, coalesce(succs, 0) AS succs, first_pred, first_succ, pos, days
        FROM gapfind f LEFT JOIN gapsum s ON s.phantom = f.phantom""",
    "reporting": """
        SELECT p.key AS a, 'person:s' || (p.s_suppkey - p.s_suppkey % 10) AS b FROM people p WHERE p.s_suppkey % 10 <> 0""",
    "allpaths": """
        SELECT s, s AS v, [s] AS path, 0 AS d FROM (SELECT DISTINCT a AS s FROM reporting WHERE a IN (SELECT v FROM verts))
        UNION ALL
        SELECT p.s, a.dst, list_append(p.path, a.dst), p.d + 1 FROM allpaths p JOIN arcs a ON a.src = p.v
        JOIN dist t ON t.s = p.s AND t.v = a.dst AND t.d = p.d + 1 WHERE p.d < 4""",
    "removedwalks": """
        SELECT g, x.v AS s, x.v AS v, 0 AS d FROM (SELECT key AS g FROM scores WHERE structural <= 10) JOIN verts x ON x.v <> g
        UNION
        SELECT w.g, w.s, a.dst, w.d + 1 FROM removedwalks w JOIN arcs a ON a.src = w.v AND a.dst <> w.g WHERE w.d < 4""",
    "risks": """
        SELECT 'coordination|' || k || '|' || so || '|' || t_o AS risk_key,
               CASE WHEN least(100, severity * 8) >= 80 THEN 'P1' WHEN severity * 8 >= 60 THEN 'P2' WHEN severity * 8 >= 35 THEN 'P3' ELSE 'P4' END AS priority,
               'coordination' AS kind, 'Brand ' || substr(sm, 14) AS team,
               greatest(35, least(95, least(sc, tc))) AS confidence, so AS source_key, t_o AS target_key FROM faults
        UNION ALL
        SELECT 'key-person|' || key, CASE WHEN 50 + greatest(0, formal - structural) * 5 >= 80 THEN 'P1'
               WHEN 50 + greatest(0, formal - structural) * 5 >= 60 THEN 'P2' ELSE 'P3' END,
               'key-person', 'Organization', greatest(40, least(96, CAST(floor(55 + c * 100 + 0.5) AS BIGINT))), key, NULL FROM scores
        UNION ALL
        SELECT 'missing-evidence|' || phantom, CASE WHEN pos = 'in_window' OR reason = 'required_sequence_step_missing' THEN 'P2' ELSE 'P3' END,
               'missing-evidence', 'Unassigned', CASE WHEN pos = 'in_window' THEN 78 ELSE 58 END, first_pred, first_succ FROM gaprows""",
}


def _on_full(view: str) -> str:
    """A view over the talk as one over all mentions, as it is over the talk of ``full_chat``."""
    names = r"\b(chat_comm|chat_edges|arcs|verts|walks|dist|sig|between|exact|scores|removedwalks|(?<=JOIN )degree)\b"
    return re.sub(names, r"full_\1", VIEWS[view])


# Every message also mentions the people whose numbers are its conversation and its place in it.
VIEWS["full_chat"] = """
        SELECT id, parent, author, t, '<@s' || (conv_id % n) || '> <@s' || (turn % n) || '|x> ' || text AS text FROM chat, n"""
VIEWS["full_chat_comm"] = re.sub(r"\bchat\b", "full_chat", VIEWS["chat_comm"])
for _view in ("chat_edges", "arcs", "verts", "walks", "dist", "sig", "between", "exact", "degree", "scores", "removedwalks"):
    VIEWS[f"full_{_view}"] = _on_full(_view)
VIEWS["full_risks"] = re.sub(r"\bscores\b", "full_scores", VIEWS["risks"])


def with_views(sql: str) -> str:
    """Prefix the SQL with the views it names, in dependency order."""
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in re.findall(r"[a-z_]+", text):
            if name in VIEWS and name not in order and name != own:
                visit(VIEWS[name], name)
                if name not in order:
                    order.append(name)

    visit(sql)
    parts = [f"{name} AS ({VIEWS[name]})" for name in order]
    body = sql.strip()
    if not parts:
        return re.sub(r"^WITH ", "WITH RECURSIVE ", body)
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE ") :]
    if body.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH ") :]
    return "WITH RECURSIVE " + ", ".join(parts) + " " + body
