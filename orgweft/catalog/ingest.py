"""Queries over scans, normalisation, identity and canonicalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.catalog.registry import query
from orgweft.catalog.views import BASE, DATASET, Views
from orgweft.functions.ids import stable_id
from orgweft.functions.text import clean_list, mentions, slug, ticket_epoch, trailer_dependencies
from orgweft.operators import canonicalize as C
from orgweft.operators import derive as D
from orgweft.operators import gaps as GAP
from orgweft.operators import identity as I
from orgweft.operators import normalize as N
from orgweft.operators import validate as V
from orgweft.plans.bundle import Bundle, canonicalize, complete, ingest_summary
from orgweft.plans.load import export_maps
from orgweft.plans.snapshot import read_snapshot, write_snapshot
from orgweft.session import empty_like, shared_folder
from orgweft.sources.commits import path_modules
from orgweft.sources.records import classify_repos
from orgweft.sources.tickets import label_keys
from orgweft.sources.workspace import role_rank
from orgweft.operators.normalize import records_of
from orgweft.schemas import meta_struct

TYPED = "CAST(count(*) AS BIGINT)"


# --- scans ------------------------------------------------------------------


@query(
    "scan_roundtrip",
    """SELECT 'Person' AS label, count(*) AS n FROM people
       UNION ALL SELECT 'Team', count(*) FROM nation
       UNION ALL SELECT 'Module', (SELECT count(*) FROM brands) + (SELECT count(*) FROM types)
       UNION ALL SELECT 'REPORTS_TO', count(*) FROM people WHERE s_suppkey % 10 <> 0""",
)
def scan_roundtrip(v: Views) -> DataFrame:
    """Write the directory graph as a snapshot, read it back verified, count it."""
    root = shared_folder(v.spark, "snapshot")
    write_snapshot(canonicalize(v.directory, DATASET), root)
    stored = read_snapshot(v.spark, root)
    return stored.nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(
        stored.edges.groupBy(F.col("rel_type").alias("label")).agg(F.count("*").alias("n"))
    )


@query(
    "mentions",
    """SELECT id, list_aggregate(list_sort(list_distinct(list_filter(
              regexp_extract_all(text, '<@([^>|]*)', 1), lambda x: length(x) > 0))), 'string_agg', ',') AS mentions
       FROM chat""",
)
def mention_scan(v: Views) -> DataFrame:
    return v.messages.select(
        F.concat_ws("-", "channel", "ts").alias("id"), F.array_join(mentions(F.col("text")), ",").alias("mentions")
    )


@query(
    "thread_parent",
    """SELECT c.id, c.t AS occurred_at_epoch, c.author AS author_id, c.parent AS thread_parent_id,
              p.author AS parent_author_id, c.m AS module_keys
       FROM chat c LEFT JOIN chat p ON p.id = c.parent""",
)
def thread_parent(v: Views) -> DataFrame:
    return v.slack_rows.select(
        "id",
        "occurred_at_epoch",
        "author_id",
        "thread_parent_id",
        "parent_author_id",
        F.array_join("module_keys", ",").alias("module_keys"),
    )


@query("multi_date", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders")
def multi_date(v: Views) -> DataFrame:
    """Dates written in the six ticket formats, one format per order priority and status."""
    stamp = F.col("o_orderdate").cast("timestamp")
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    formats = {
        "1-URGENT": "d/MMM/yyyy h:mm a",
        "2-HIGH": "d/MMM/yyyy HH:mm",
        "3-MEDIUM": "yyyy-MM-dd HH:mm",
        "4-NOT SPECIFIED": "yyyy-MM-dd",
        "5-LOW": "dd/MMM/yy hh:mm a",
    }
    for priority, fmt in formats.items():
        text = F.when(F.col("o_orderpriority") == priority, F.date_format(stamp, fmt)).otherwise(text)
    text = F.when(F.col("o_orderstatus") == "P", F.date_format(stamp, "d/MMM/yy HH:mm")).otherwise(text)
    return v.table("orders").select("o_orderkey", ticket_epoch(text).alias("epoch"))


def _paths(v: Views) -> DataFrame:
    return v.table("pages").select(
        F.col("page_id").alias("id"), F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("path")
    )


@query(
    "path_modules",
    r"""WITH paths AS (SELECT page_id AS id, regexp_extract(url, '^https?://([^?#]+)', 1) AS path FROM pages),
         prefixes AS (SELECT DISTINCT split_part(path, '/', 1) AS p, 'host' AS m FROM paths
                      UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2),
                                   'lang-' || split_part(path, '/', 2) FROM paths)
       SELECT id, string_agg(DISTINCT m, ',' ORDER BY m) AS module_keys
       FROM paths JOIN prefixes ON path = p OR starts_with(path, p || '/') GROUP BY id""",
)
def path_module_scan(v: Views) -> DataFrame:
    paths = _paths(v)
    host = F.substring_index("path", "/", 1)
    section = F.split_part("path", F.lit("/"), F.lit(2))
    prefixes = paths.select(F.concat(host, F.lit("/")).alias("prefix"), F.lit("host").alias("module")).union(
        paths.select(F.concat_ws("/", host, section), F.concat(F.lit("lang-"), section))
    )
    return path_modules(paths, prefixes.distinct()).select(
        "id", F.array_join("module_keys", ",").alias("module_keys")
    )


@query(
    "trailers",
    """SELECT sha, string_agg(m, ',' ORDER BY m) AS dependency_keys FROM commit_modules GROUP BY sha""",
)
def trailer_scan(v: Views) -> DataFrame:
    """Trailer lines built from the order's brands, with noise lines, read back."""
    commits = v.commit_rows.where(F.size("module_keys") > 0)
    body = F.concat(
        F.col("message"),
        F.lit("\n\n  Depends-On: module:"),
        F.array_join("module_keys", " , "),
        F.lit("\nDepends-On: "),
        F.get("module_keys", F.lit(0)),
        F.lit(",\nSee-Also: other"),
    )
    return commits.select("sha", F.array_join(trailer_dependencies(body), ",").alias("dependency_keys"))


@query(
    "label_modules",
    """SELECT o_orderkey AS id, lower(replace(replace(o_orderpriority, ' ', '-'), '_', '-')) AS mapped FROM orders
       WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1)""",
)
def label_module_scan(v: Views) -> DataFrame:
    orders = v.table("orders")
    labelled = orders.select(
        F.col("o_orderkey").alias("id"),
        clean_list(F.split(F.concat_ws("; ", "o_orderpriority", "o_orderstatus"), "[;,]")).alias("labels"),
    )
    known = orders.select(
        F.col("o_orderpriority").alias("label"), slug(F.col("o_orderpriority")).alias("module")
    ).distinct()
    return label_keys(labelled, known).select("id", F.array_join("mapped", ",").alias("mapped"))


@query(
    "role_rank",
    """SELECT c_mktsegment AS segment, CASE c_nationkey % 7 WHEN 0 THEN 6 WHEN 1 THEN 1 WHEN 2 THEN 1
              WHEN 3 THEN 5 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 0 END AS role_rank, count(*) AS n
       FROM customer GROUP BY ALL""",
)
def role_rank_scan(v: Views) -> DataFrame:
    titles = F.array(
        *[
            F.lit(t)
            for t in (
                " VP of Engineering ",
                "Senior Software Engineer",
                "QA Specialist",
                "Director, Operations",
                "Lead UX Researcher",
                "Product Manager",
                "Clerk",
            )
        ]
    )
    people = v.table("customer").select(
        F.col("c_mktsegment").alias("segment"), role_rank(F.get(titles, F.col("c_nationkey") % 7)).alias("role_rank")
    )
    return people.groupBy("segment", "role_rank").agg(F.count("*").alias("n"))


@query(
    "repo_class",
    """WITH repos AS (SELECT p_partkey AS repo, lower(p_name || ' ' || p_type || ' ' || p_brand) AS blob FROM part),
         slugs AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS slug FROM part
                   UNION SELECT DISTINCT lower(p_type) FROM part)
       SELECT repo, (SELECT slug FROM slugs WHERE contains(blob, slug)
                     ORDER BY length(slug) DESC, slug LIMIT 1) AS "group" FROM repos""",
)
def repo_class(v: Views) -> DataFrame:
    part = v.table("part")
    repos = part.select(
        F.col("p_partkey").alias("repo"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.array(F.lower("p_brand")).alias("topics"),
    )
    groups = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("slug")).union(
        part.select(F.lower("p_type"))
    )
    return classify_repos(repos, groups)


@query(
    "slugs",
    r"""SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages""",
)
def slug_scan(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", slug(F.col("url")).alias("slug"))


# --- normalisation ----------------------------------------------------------


def _talk_columns(records: DataFrame) -> DataFrame:
    return records.where("kind = 'communication_aggregate'").select(
        "external_id",
        "occurred_at_epoch",
        F.col("meta.sender_external_id").alias("sender"),
        F.col("meta.recipient_external_id").alias("recipient"),
        F.col("meta.interaction_kind").alias("kind"),
        "content_sha256",
    )


@query(
    "slack_records",
    r"""WITH x AS (
          SELECT c.id, c.t, c.author, p.author AS recipient, 'reply' AS kind, '' AS tail
          FROM chat c JOIN chat p ON p.id = c.parent WHERE p.author <> c.author
          UNION ALL
          SELECT id, t, author, m, 'mention', CASE WHEN m = answered THEN ':mention' ELSE '' END FROM (
              SELECT DISTINCT c.id, c.t, c.author, p.author AS answered, unnest(regexp_extract_all(c.text, '<@([^>|]+)', 1)) AS m
              FROM chat c LEFT JOIN chat p ON p.id = c.parent)
          WHERE m <> author)
       SELECT 'slack:' || id || ':communication:' || recipient || tail AS external_id, t AS occurred_at_epoch,
              author AS sender, recipient, kind,
              sha256('slack' || chr(10) || id || chr(10) || author || chr(10) || recipient || chr(10) || kind) AS content_sha256
       FROM x""",
)
def slack_record_scan(v: Views) -> DataFrame:
    return _talk_columns(N.slack_records(v.slack_rows))


@query(
    "email_records",
    r"""WITH e AS (SELECT doc_id, 'd' || doc_id AS id, 'S' || (doc_id % n) || '@Example.COM' AS f,
                        CASE WHEN doc_id > 0 THEN 'S' || ((doc_id - 1) % n) || '@Example.COM' END AS pa,
                        ['<s' || ((doc_id * 3) % n) || '@example.com>', 'mailto:x' || (doc_id % 17) || '@else.org'] AS ts
                 FROM documents, n),
         x AS (SELECT doc_id, id, f, pa AS r, 'reply' AS kind FROM e WHERE pa IS NOT NULL AND pa <> f
               UNION ALL
               SELECT doc_id, id, f, r, 'email' FROM (SELECT doc_id, id, f, pa, unnest(ts) AS r FROM e)
               WHERE r <> f AND r <> coalesce(pa, f))
       SELECT 'email:' || id || ':communication:' || r AS external_id,
              1704067200 + doc_id * 600 AS occurred_at_epoch, f AS sender, r AS recipient, kind,
              sha256('email' || chr(10) || id || chr(10) || f || chr(10) || r || chr(10) || kind) AS content_sha256
       FROM x""",
)
def email_record_scan(v: Views) -> DataFrame:
    return _talk_columns(N.email_records(v.email_rows))


@query(
    "ticket_records",
    r"""SELECT 'ticket:p' || page_id AS external_id, 1704067200 + page_id * 3600 AS occurred_at_epoch,
              's' || (page_id % n) AS author_external_id,
              'artifact:ticket:p' || page_id || ',module:brand-' || (1 + page_id % 25) AS subjects,
              sha256(regexp_replace(url, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) ||
                     regexp_replace(html, '^\s+|\s+$', '', 'g')) AS content_sha256
       FROM pages, n""",
)
def ticket_record_scan(v: Views) -> DataFrame:
    return N.ticket_records(v.ticket_rows).select(
        "external_id",
        "occurred_at_epoch",
        "author_external_id",
        F.array_join("subjects", ",").alias("subjects"),
        "content_sha256",
    )


@query("cochange_pairs", "SELECT 'git:' || sha || ':cochange:module:' || a || ':module:' || b AS external_id, a, b FROM cochange")
def cochange_pairs(v: Views) -> DataFrame:
    return N.cochange_records(v.commit_rows).select(
        "external_id",
        F.col("meta.source_module_external_id").alias("a"),
        F.col("meta.target_module_external_id").alias("b"),
    )


@query(
    "explicit_deps",
    """SELECT c.sha, c.m AS source_module, 'brand-' || substr(p_brand, 7) AS target_module
       FROM commit_modules c JOIN part ON p_partkey = CAST(substr(sha, 2) AS BIGINT) % (SELECT count(*) FROM part)""",
)
def explicit_deps(v: Views) -> DataFrame:
    """Each order names the brand of one part as its dependency."""
    count = v.table("part").select(F.count("*")).scalar()
    named = v.table("part").select(F.col("p_partkey").alias("k"), slug(F.col("p_brand")).alias("brand"))
    rows = (
        v.commit_rows.withColumn("k", F.substr("sha", F.lit(2)).cast("bigint") % count)
        .join(named, "k")
        .withColumn("dependency_keys", F.array("brand"))
    )
    return N.dependency_records(rows).select(
        F.regexp_extract("external_id", "^git:([^:]+):", 1).alias("sha"),
        F.col("meta.source_module_external_id").alias("source_module"),
        F.col("meta.target_module_external_id").alias("target_module"),
    )


# --- identity ---------------------------------------------------------------


def _lookup(v: Views) -> DataFrame:
    return I.handle_lookup(v.identity_map, v.handles)


def _undigested(column):
    return F.regexp_replace(column, "-[0-9a-f]{8}$", "")


@query(
    "resolve_ids",
    """SELECT 'd' || doc_id AS id, 's' || (doc_id % n) AS from_id,
              CASE WHEN doc_id > 0 THEN 's' || ((doc_id - 1) % n) END AS parent_author_id,
              's' || ((doc_id * 3) % n) || ',unresolved-x' || (doc_id % 17) AS to_ids
       FROM documents, n""",
)
def resolve_ids(v: Views) -> DataFrame:
    """Raw addresses to handles; the digest of made handles is left off for the comparison."""
    rows = I.resolve_rows(v.email_rows, "email", _lookup(v))
    return rows.select(
        "id",
        "from_id",
        "parent_author_id",
        F.array_join(F.array_sort(F.transform("to_ids", _undigested)), ",").alias("to_ids"),
    )


@query(
    "unresolved_stubs",
    """SELECT DISTINCT 'unresolved-x' || (doc_id % 17) AS handle, 'x' || (doc_id % 17) || '@else.org' AS display_name,
              0 AS role_rank FROM documents""",
)
def unresolved_stubs(v: Views) -> DataFrame:
    missing = I.unresolved_ids(v.email_rows, "email", _lookup(v))
    stubs = I.unresolved_stubs(missing, v.handles, source="bench-identity", epoch=F.lit(0))
    return stubs.select(
        _undigested("external_id").alias("handle"),
        F.col("meta.display_name").alias("display_name"),
        F.col("meta.role_rank").cast("int").alias("role_rank"),
    )


@query(
    "identity_limitation",
    """WITH ids AS (SELECT DISTINCT 'x' || (doc_id % 17) || '@else.org' AS i FROM documents)
       SELECT count(*) || ' source identities were not in the identity map and were kept as unresolved handles: '
              || (SELECT string_agg(i, ', ' ORDER BY i) FROM (SELECT i FROM ids ORDER BY i LIMIT 5))
              || CASE WHEN count(*) > 5 THEN ' (+' || (count(*) - 5) || ' more)' ELSE '' END
              || '. Ghost and Faultline results for those people are per-source-id, not per-person.' AS limitation
       FROM ids""",
)
def identity_limitation(v: Views) -> DataFrame:
    return I.unresolved_limitation(I.unresolved_ids(v.email_rows, "email", _lookup(v)))


def _pricey(v: Views) -> DataFrame:
    part = v.table("part")
    mean = part.select(F.avg("p_retailprice")).scalar()
    return (
        part.groupBy(slug(F.col("p_brand")).alias("module"))
        .agg(F.avg("p_retailprice").alias("p"))
        .where(F.col("p") > mean)
        .select("module")
    )


_PRICEY = """pricey AS (SELECT 'brand-' || substr(p_brand, 7) AS m FROM part GROUP BY p_brand
             HAVING avg(p_retailprice) > (SELECT avg(p_retailprice) FROM part))"""


@query(
    "drop_unknown_modules",
    f"""WITH {_PRICEY}
       SELECT c.sha, coalesce(string_agg(k.m, ',' ORDER BY k.m), '') AS module_keys
       FROM commits c LEFT JOIN (SELECT sha, m FROM commit_modules JOIN pricey USING (m)) k USING (sha)
       GROUP BY c.sha""",
)
def drop_unknown_modules(v: Views) -> DataFrame:
    kept = I.drop_unknown_modules(v.commit_rows, _pricey(v), "sha")
    return kept.select("sha", F.array_join("module_keys", ",").alias("module_keys"))


@query(
    "unknown_modules",
    f"""WITH {_PRICEY} SELECT DISTINCT m AS module FROM commit_modules WHERE m NOT IN (SELECT m FROM pricey)""",
)
def unknown_modules(v: Views) -> DataFrame:
    return I.unknown_modules(v.commit_rows, _pricey(v))


def _observations(v: Views) -> DataFrame:
    """Customers as mail senders seen under two names each."""
    email = F.when(
        F.col("c_mktsegment") == "BUILDING",
        F.concat(F.lit("b"), F.col("c_custkey").cast("string"), F.lit("@org.example")),
    ).otherwise(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example")))
    bucket = F.floor(F.col("c_acctbal") / 100).cast("string")
    cents = F.floor(F.abs("c_acctbal") * 7).cast("bigint")
    names = F.array(
        F.concat(F.lit("Náme (via list) "), F.col("c_nationkey").cast("string"), F.lit("-"), bucket),
        F.concat(F.lit("Seg_"), F.col("c_mktsegment"), F.lit(" "), cents.cast("string")),
    )
    return v.table("customer").select(
        F.explode(names).alias("name"),
        email.alias("email"),
        F.concat(F.lit("U"), (F.col("c_custkey") % 10).cast("string")).alias("ticket_user"),
    )


_OBSERVED = r"""seen AS (
        SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' || c_custkey || '@org.example'
                    ELSE 'c' || c_custkey || '@mail.example' END AS email,
               unnest(['name ' || c_nationkey || ' ' || trim(replace(CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR), '-', ' ')),
                       'seg ' || lower(c_mktsegment) || ' ' || CAST(floor(abs(c_acctbal) * 7) AS BIGINT)]) AS name
        FROM customer),
    ties AS (SELECT DISTINCT x.email AS a, y.email AS b FROM seen x JOIN seen y USING (name)),
    member AS (SELECT email AS v, email AS c FROM seen UNION SELECT t.b, m.c FROM member m JOIN ties t ON t.a = m.v),
    clusters AS (SELECT v AS email, min(c) AS cluster FROM member GROUP BY v)"""


@query("observation_counts", f"WITH {_OBSERVED} SELECT name AS name_key, count(*) AS n, count(DISTINCT email) AS emails FROM seen GROUP BY name")
def observation_counts(v: Views) -> DataFrame:
    _emails, names, _users = I.observation_counts(_observations(v))
    return names.groupBy("name_key").agg(F.sum("n").alias("n"), F.count("*").alias("emails"))


@query("identity_clusters", f"WITH {_OBSERVED} SELECT email, cluster FROM clusters")
def identity_clusters(v: Views) -> DataFrame:
    emails, names, _users = I.observation_counts(_observations(v))
    return I.identity_clusters(emails, names)


@query(
    "cluster_names",
    rf"""WITH {_OBSERVED},
      e AS (SELECT email, count(*) AS n FROM seen GROUP BY email),
      ce AS (SELECT cluster, email, n FROM clusters JOIN e USING (email)),
      nm AS (SELECT cluster, name, count(*) AS n FROM clusters JOIN seen USING (email) GROUP BY ALL),
      roster AS (SELECT 'name ' || n_nationkey || ' 5' AS name, 'roster-' || n_nationkey AS rid FROM nation)
    SELECT cluster, coalesce(
        (SELECT split_part(email, '@', 1) FROM ce x WHERE x.cluster = c.cluster AND email LIKE '%@org.example' ORDER BY n DESC, email LIMIT 1),
        (SELECT rid FROM nm JOIN roster USING (name) WHERE nm.cluster = c.cluster ORDER BY n DESC, name LIMIT 1),
        (SELECT split_part(email, '@', 1) FROM ce x WHERE x.cluster = c.cluster ORDER BY n DESC, email LIMIT 1)) AS handle
    FROM (SELECT DISTINCT cluster FROM clusters) c""",
)
def cluster_names(v: Views) -> DataFrame:
    emails, names, _users = I.observation_counts(_observations(v))
    roster = v.table("nation").select(
        F.concat(F.lit("name "), F.col("n_nationkey").cast("string"), F.lit(" 5")).alias("name_key"),
        F.concat(F.lit("roster-"), F.col("n_nationkey").cast("string")).alias("roster_id"),
    )
    clusters = I.identity_clusters(emails, names)
    return I.cluster_handles(clusters, emails, names, roster, "org.example").select("cluster", "handle")


@query(
    "roster_ranks",
    """SELECT lower(c_mktsegment) || c_nationkey AS roster_id, max(CASE WHEN c_acctbal > 9000 THEN 4 ELSE 3 END) AS role_rank
       FROM customer GROUP BY 1""",
)
def roster_ranks(v: Views) -> DataFrame:
    ids = v.table("customer").select(
        F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("roster_id"), "c_acctbal"
    )
    return I.roster_ranks(ids, ids.where("c_acctbal > 9000"))


_CANDIDATES = """cand AS (SELECT 'cand:' || team AS c, * FROM people WHERE s_acctbal < 1500),
    multi AS (SELECT c FROM cand GROUP BY c HAVING count(*) >= 2),
    mem AS (SELECT cand.* FROM cand JOIN multi USING (c)),
    ed AS (SELECT a, b, 'COMMUNICATES' AS r, a || b AS k FROM comm_edges
           UNION ALL SELECT 'person:s' || s_suppkey, 'person:s' || (s_suppkey - s_suppkey % 10), 'REPORTS_TO', 'r' || s_suppkey
                     FROM people WHERE s_suppkey % 10 <> 0),
    touched AS (SELECT x.c, k, r, max(CASE WHEN x.key = a THEN 1 ELSE 0 END) AS ia, max(CASE WHEN x.key = b THEN 1 ELSE 0 END) AS ib, a, b
                FROM ed JOIN mem x ON x.key = a OR x.key = b GROUP BY x.c, k, r, a, b),
    eff AS (SELECT c, count(*) AS affected, count(*) - count(DISTINCT (CASE WHEN ia = 1 THEN 'candidate' ELSE a END,
                   CASE WHEN ib = 1 THEN 'candidate' ELSE b END, r)) AS dup FROM touched GROUP BY c)"""


@query(
    "identity_candidates",
    f"""WITH {_CANDIDATES}
    SELECT c AS candidate_id,
           (SELECT key FROM mem x WHERE x.c = m.c ORDER BY s_acctbal <= 750, key LIMIT 1) AS proposed_person_key,
           min(50 + s_suppkey % 50) AS confidence,
           string_agg(DISTINCT CASE WHEN s_acctbal < 0 THEN 'negative' ELSE 'low' END, ','
                      ORDER BY CASE WHEN s_acctbal < 0 THEN 'negative' ELSE 'low' END) AS signals,
           count(*) - 1 AS projected_node_reduction,
           coalesce((SELECT affected FROM eff WHERE eff.c = m.c), 0) AS affected_edge_count,
           coalesce((SELECT dup FROM eff WHERE eff.c = m.c), 0) AS duplicate_relationships_removed,
           CASE WHEN count(*) > 2 THEN 'accepted' ELSE 'pending' END AS status
    FROM mem m GROUP BY c""",
)
def identity_candidates(v: Views) -> DataFrame:
    """Merge candidates with the latest decision: large groups were rejected, then accepted."""
    base = canonicalize(v.people, DATASET)
    pairs = v.talk_pairs
    edges = base.edges.select(*pairs.columns).unionByName(pairs)
    sizes = I.candidate_members(base.nodes).groupBy("candidate_id").agg(F.count("*").alias("n"))
    large = sizes.where("n > 2")
    decisions = large.select("candidate_id", F.lit("rejected").alias("status"), F.lit(1).alias("decided_at")).union(
        large.select("candidate_id", F.lit("accepted"), F.lit(2))
    )
    found = I.identity_candidates(base.nodes, edges, decisions)
    return found.select(
        "candidate_id",
        "proposed_person_key",
        "confidence",
        F.array_join("signals", ",").alias("signals"),
        "projected_node_reduction",
        "affected_edge_count",
        "duplicate_relationships_removed",
        "status",
    )


# --- records and canonicalisation -------------------------------------------


def _document_records(v: Views, external_id, source) -> DataFrame:
    """Documents as artifact records under the given source and id."""
    return records_of(
        v.table("documents"),
        meta_struct(artifact_kind=F.lit("document")),
        source=source,
        external_id=external_id,
        kind=F.lit("artifact"),
        occurred_at_epoch=F.lit(BASE),
        subjects=F.array(F.concat(F.lit("artifact:"), external_id)),
        content_sha256=N.content_hash(F.col("text")),
        content=F.col("text"),
    )


@query(
    "record_dedup",
    "SELECT 'docs' AS source, sha256(text) AS external_id FROM documents GROUP BY text",
)
def record_dedup(v: Views) -> DataFrame:
    """Exact copies are one record."""
    records = _document_records(v, F.sha2("text", 256), F.lit("docs"))
    return C.deduplicate(records).select("source", "external_id")


@query(
    "record_conflicts",
    """SELECT source, lang || '-' || n_chars AS external_id, count(*) AS copies FROM documents
       GROUP BY source, lang, n_chars HAVING count(DISTINCT text) > 1""",
)
def record_conflicts(v: Views) -> DataFrame:
    """One id with different contents."""
    key = F.concat_ws("-", "lang", F.col("n_chars").cast("string"))
    return C.conflicting_records(_document_records(v, key, F.col("source")))


@query(
    "evidence",
    r"""WITH r AS (SELECT 'd/' || doc_id || ' ' || lang AS x, * FROM documents)
       SELECT 'evidence:' || sha256('bench|evidence|{"author_external_id":null,"content":' || CAST(to_json(text) AS VARCHAR) ||
              ',"content_sha256":"' || sha256(text) || '","external_id":"' || x || '","kind":"artifact","metadata":{"artifact_kind":"document"},' ||
              '"occurred_at_epoch":1704067200,"parent_external_id":null,"source":"' || source || '","subjects":["artifact:' || x || '"]}') AS evidence_id,
              'record://' || source || '/d%2F' || doc_id || '%20' || lang AS source_uri,
              'artifact:' || x AS subject_key, 'artifact:' || x AS object_key, 'observed' AS evidence_class,
              '[content redacted]' AS redacted_excerpt,
              '{"author_external_id":null,"metadata":{"artifact_kind":"document"},"parent_external_id":null,"subjects":["artifact:' || x || '"]}' AS metadata_json
       FROM r""",
)
def evidence(v: Views) -> DataFrame:
    """Evidence rows with their content-addressed ids, over the whole texts."""
    key = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"))
    rows = C.evidence_of(C.deduplicate(_document_records(v, key, F.col("source"))), DATASET)
    return rows.select(
        "evidence_id",
        "source_uri",
        "subject_key",
        "object_key",
        "evidence_class",
        "redacted_excerpt",
        "metadata_json",
    )


@query(
    "nodes",
    """SELECT key AS canonical_key, 'Person' AS label, name AS title, rank AS number, 1 AS sources FROM people
       UNION ALL SELECT 'team:nation-' || n_nationkey, 'Team', 'nation-' || n_nationkey, NULL, 1 FROM nation
       UNION ALL SELECT 'module:' || m, 'Module', p_brand, NULL, 1 FROM brands
       UNION ALL SELECT 'module:' || m, 'Module', p_type, NULL, 1 FROM types
       UNION ALL SELECT 'artifact:git:' || sha, 'Artifact', 'commit', t, 1 FROM commits
       UNION ALL SELECT 'artifact:slack:' || id, 'Artifact', 'message', t, 1 FROM chat""",
)
def nodes(v: Views) -> DataFrame:
    links = v.base.node_evidence.groupBy(F.col("node_key").alias("canonical_key")).agg(
        F.count("*").cast("int").alias("sources")
    )
    return v.base.nodes.join(links, "canonical_key").select(
        "canonical_key",
        "label",
        F.coalesce("props.display_name", "props.name", "props.kind").alias("title"),
        F.coalesce("props.role_rank", "props.created_epoch").alias("number"),
        "sources",
    )


@query(
    "observed_edges",
    """SELECT 'reporting:s' || s_suppkey || ':s' || (s_suppkey - s_suppkey % 10) AS canonical_key,
              'REPORTS_TO' AS rel_type, 789004800 AS observed_epoch FROM people WHERE s_suppkey % 10 <> 0
       UNION ALL SELECT 'authorship:' || author || ':git:' || sha, 'AUTHORED', t FROM commits
       UNION ALL SELECT 'authorship:' || author || ':slack:' || id, 'AUTHORED', t FROM chat
       UNION ALL SELECT 'about:git:' || sha || ':' || m, 'ABOUT', t FROM commit_modules JOIN commits USING (sha)
       UNION ALL SELECT 'about:slack:' || id || ':' || m, 'ABOUT', t FROM chat
       UNION ALL SELECT 'replies_to:slack:' || c.id || ':slack:' || c.parent, 'REPLIES_TO', c.t
                 FROM chat c JOIN chat p ON p.id = c.parent""",
)
def observed_edges(v: Views) -> DataFrame:
    return v.base.edges.select(
        "canonical_key", "rel_type", F.col("props.observed_epoch").alias("observed_epoch")
    )


@query("stable_ids")
def stable_ids(v: Views) -> DataFrame:
    """Ids of all people and their ranges; the hash has no SQL counterpart."""
    ids = v.people.select(
        F.col("external_id"), stable_id(DATASET, "Person", F.concat(F.lit("person:"), F.col("external_id"))).alias("id")
    )
    return ids.where((F.col("id") > 0))


@query(
    "integrity",
    """SELECT 'about:git:' || sha || ':' || m AS key, 'endpoint is missing' AS rule FROM commit_modules
       WHERE m IN (SELECT 'brand-' || substr(p_brand, 7) FROM part GROUP BY p_brand
                   HAVING avg(p_retailprice) <= (SELECT avg(p_retailprice) FROM part))""",
)
def integrity(v: Views) -> DataFrame:
    """Edges whose module is missing because only the dearer brands are declared."""
    declared = v.modules.join(
        _pricey(v).select(F.concat(F.lit("module-"), F.col("module")).alias("external_id")), "external_id", "left_semi"
    ).select(*v.modules.columns)
    base = canonicalize(N.union_all(v.people, v.teams, declared, v.artifact_records), DATASET)
    return base.quarantine.select("key", "rule").unionByName(V.bundle_violations(base))


@query(
    "record_checks",
    """SELECT source || '/' || lang AS key, 'subjects must be non-empty' AS rule FROM documents WHERE n_chars < 200
       UNION ALL SELECT source || '/' || lang, 'content_sha256 must be 64 hex digits' FROM documents WHERE n_chars >= 200""",
)
def record_checks(v: Views) -> DataFrame:
    docs = v.table("documents")
    short = F.col("n_chars") < 200
    records = records_of(
        docs,
        meta_struct(artifact_kind=F.lit("document")),
        source=F.col("source"),
        external_id=F.col("lang"),
        kind=F.lit("artifact"),
        occurred_at_epoch=F.lit(BASE),
        subjects=F.when(short, F.array(F.lit(" "))).otherwise(F.array(F.lit("artifact:a"))),
        content_sha256=F.when(short, N.empty_sha256()).otherwise(F.lit("none")),
        content=F.col("text"),
    )
    return V.record_violations(records)


@query(
    "contract_checks",
    """SELECT 'contract:conv-' || conv_id AS key, 'ordinals must increase' AS rule FROM conversations GROUP BY conv_id HAVING max(turn) >= 5
       UNION ALL SELECT 'contract:conv-' || conv_id, 'at least two steps' FROM conversations GROUP BY conv_id HAVING max(turn) < 3""",
)
def contract_checks(v: Views) -> DataFrame:
    """Contracts spoiled by the length of their conversation."""
    return V.contract_violations(_spoiled_contracts(v))


def _spoiled_contracts(v: Views) -> DataFrame:
    longest = v.table("conversations").groupBy(
        F.concat(F.lit("contract:conv-"), F.col("conv_id").cast("string")).alias("contract_id")
    ).agg(F.max("turn").alias("last"))
    steps = (
        F.when(F.col("last") >= 5, F.reverse("steps"))
        .when(F.col("last") < 3, F.slice("steps", 1, 1))
        .otherwise(F.col("steps"))
    )
    return v.contracts.join(longest, "contract_id").withColumn("steps", steps)


@query(
    "derivation_checks",
    """SELECT 'talk/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key,
              'interaction kind is unknown' AS rule
       FROM lineitem, n WHERE l_returnflag = 'N' AND l_suppkey <> l_partkey % n""",
)
def derivation_checks(v: Views) -> DataFrame:
    """Talk whose kind is not one of the known three."""
    found = V.derivation_violations(
        canonicalize(empty_like(v.talk), DATASET, facts={"communication_aggregate": _with_unknown_kind(v)}).evidence
    )
    return found.select(F.regexp_replace("key", r"-[^-]*$", "").alias("key"), "rule")


def _with_unknown_kind(v: Views) -> DataFrame:
    kind = F.col("meta.interaction_kind")
    return v.talk.withColumn(
        "meta",
        F.col("meta").withField(
            "interaction_kind", F.when(kind == "email", F.lit("phone")).otherwise(kind)
        ),
    )


@query(
    "quarantine",
    """SELECT 'evidence' AS stage, 'directory/' || id AS key, 'record is stated in different ways' AS rule FROM people WHERE s_suppkey % 10 = 3
       UNION ALL SELECT 'nodes', key, 'node is stated in different ways' FROM people WHERE s_suppkey % 10 = 4
       UNION ALL SELECT 'edges', 'reporting:' || id || ':s' || (s_suppkey - 4), 'endpoint is missing' FROM people WHERE s_suppkey % 10 = 4""",
)
def quarantine(v: Views) -> DataFrame:
    """People stated anew: by the same record with another time, by another source with another rank."""
    number = F.substring("external_id", 2, 20).cast("bigint")
    again = v.people.where(number % 10 == 3).withColumn("occurred_at_epoch", F.col("occurred_at_epoch") + 1)
    other = v.people.where(number % 10 == 4).withColumn("source", F.lit("payroll")).withColumn(
        "meta", F.col("meta").withField("role_rank", F.col("meta.role_rank") + 1)
    )
    return canonicalize(N.union_all(v.people, v.people, again, other), DATASET).quarantine


@query(
    "quarantine_derived",
    """SELECT 'derivation' AS stage, 'talk/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key,
              'interaction kind is unknown' AS rule
       FROM lineitem, n WHERE l_returnflag = 'N' AND l_suppkey <> l_partkey % n
       UNION ALL SELECT 'contracts', 'contract:conv-' || conv_id, 'ordinals must increase' FROM conversations GROUP BY conv_id HAVING max(turn) >= 5
       UNION ALL SELECT 'contracts', 'contract:conv-' || conv_id, 'at least two steps' FROM conversations GROUP BY conv_id HAVING max(turn) < 3
       UNION ALL SELECT 'kept', 'COMMUNICATES', CAST(sum(q) AS VARCHAR) FROM comm WHERE kind <> 'email'
       UNION ALL SELECT 'kept', 'contracts', CAST(count(DISTINCT contract) AS VARCHAR) FROM preceded
         WHERE contract IN (SELECT 'contract:conv-' || conv_id FROM conversations GROUP BY conv_id HAVING max(turn) BETWEEN 3 AND 4)""",
)
def quarantine_derived(v: Views) -> DataFrame:
    """What ``complete`` sets aside, and what it still makes of the rest."""
    base = canonicalize(
        N.union_all(v.people, v.modules, v.thread_records),
        DATASET,
        facts={"communication_aggregate": _with_unknown_kind(v)},
    )
    whole = complete(base, _spoiled_contracts(v))
    words = whole.of_type("COMMUNICATES").agg(F.sum("props.weight").cast("string").alias("rule"))
    chains = whole.of_type("PRECEDED_BY").select(F.regexp_extract("canonical_key", r"conv-\d+", 0).alias("c"))
    shown = N.union_all(
        words.select(F.lit("kept").alias("stage"), F.lit("COMMUNICATES").alias("key"), "rule"),
        chains.agg(F.count_distinct("c").cast("string").alias("rule")).select(
            F.lit("kept").alias("stage"), F.lit("contracts").alias("key"), "rule"
        ),
    )
    trimmed = F.when(F.col("stage") == "derivation", F.regexp_replace("key", r"-[^-]*$", "")).otherwise(F.col("key"))
    return whole.quarantine.withColumn("key", trimmed).unionByName(shown)


@query(
    "ingest_summary",
    """SELECT 'nodes' AS measure, (SELECT count(*) FROM people) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM brands)
              + (SELECT count(*) FROM types) AS n
       UNION ALL SELECT 'edges', count(*) FROM people WHERE s_suppkey % 10 <> 0
       UNION ALL SELECT 'evidence', (SELECT count(*) FROM people) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM brands)
              + (SELECT count(*) FROM types)
       UNION ALL SELECT 'people', count(*) FROM people
       UNION ALL SELECT 'unresolved_people', count(*) FROM people WHERE unresolved
       UNION ALL SELECT 'limitations', 0""",
)
def summary(v: Views) -> DataFrame:
    return ingest_summary(canonicalize(v.directory, DATASET))


@query(
    "export_maps",
    """SELECT unnest([id, id || '@users.noreply.github.com', '@' || id]) AS source_id, id AS handle FROM people
       UNION ALL SELECT m || '/', m FROM brands UNION ALL SELECT m || '/', m FROM types""",
)
def export_map_scan(v: Views) -> DataFrame:
    aliases, prefixes = export_maps(v.handles, v.module_names.select("module"))
    return aliases.union(prefixes)


# --- derivation and gaps ----------------------------------------------------


@query("communicates", "SELECT a AS source_key, b AS target_key, mention_weight, reply_weight, email_weight, weight, first_epoch, last_epoch FROM comm_edges")
def communicates(v: Views) -> DataFrame:
    props = ("mention_weight", "reply_weight", "email_weight", "weight", "first_epoch", "last_epoch")
    return v.talk_edges.select("source_key", "target_key", *[F.col(f"props.{p}").alias(p) for p in props])


@query(
    "talk_evidence",
    "SELECT 'communicates:' || a || ':' || b || ':aggregate' AS edge_key, count(*) AS records FROM comm GROUP BY ALL",
)
def talk_evidence(v: Views) -> DataFrame:
    """Supporting records per communication edge, from the link table."""
    _edges, links = D.communicates(v.evidence_of(v.talk), DATASET)
    return links.groupBy("edge_key").agg(F.count("*").alias("records"))


def _owns(edges: DataFrame) -> DataFrame:
    return edges.select(
        "canonical_key",
        F.col("props.attributed_count").alias("attributed"),
        F.col("props.total_attributed_count").alias("total"),
        F.col("props.confidence").alias("confidence"),
        F.col("props.owner_rank").alias("owner_rank"),
    )


@query(
    "owns_aggregate",
    """SELECT 'owns:' || substr(owner, 8) || ':' || substr(module, 8) || ':authorship_density' AS canonical_key, attributed, total,
              CAST(round_even(attributed * 1.0 / total * 100, 0) AS BIGINT) AS confidence, CAST(NULL AS BIGINT) AS owner_rank
       FROM aggregated""",
)
def owns_aggregate(v: Views) -> DataFrame:
    return _owns(D.owns_aggregate(v.evidence_of(v.authorship), DATASET)[0])


@query(
    "owns_assertion",
    """SELECT 'owns:' || substr(owner, 8) || ':' || substr(module, 8) || ':assertion:' || rec AS canonical_key, authority,
              authority_rank, confidence, observed AS valid_from_epoch, until AS valid_until_epoch FROM asserted""",
)
def owns_assertion(v: Views) -> DataFrame:
    edges = D.owns_assertion(v.evidence_of(v.assertions), DATASET)[0]
    props = ("authority", "authority_rank", "confidence", "valid_from_epoch", "valid_until_epoch")
    return edges.select("canonical_key", *[F.col(f"props.{p}").alias(p) for p in props])


def _commit_base(v: Views) -> Bundle:
    return canonicalize(N.union_all(v.people, v.modules, v.artifact_records, v.thread_records), DATASET)


@query(
    "owns_density",
    """SELECT 'owns:' || substr(owner, 8) || ':' || substr(module, 8) || ':authorship_density_derived' AS canonical_key, attributed,
              total, greatest(1, least(100, CAST(round_even(attributed * 1.0 / total * 100, 0) AS BIGINT))) AS confidence, owner_rank
       FROM density WHERE owner_rank <= 3""",
)
def owns_density(v: Views) -> DataFrame:
    base = _commit_base(v)
    return _owns(D.owns_density(base.evidence, base.edges, base.edge_evidence, DATASET)[0])


def _depends(edges: DataFrame) -> DataFrame:
    return edges.select(
        "canonical_key",
        F.col("props.dependency_kind").alias("kind"),
        F.col("props.weight").alias("weight"),
        "evidence_class",
    )


@query(
    "depends_explicit",
    """SELECT 'depends_on:' || a || ':' || b || ':import' AS canonical_key, 'import' AS kind, w AS weight, 'observed' AS evidence_class FROM deps""",
)
def depends_explicit(v: Views) -> DataFrame:
    return _depends(D.depends_explicit(v.evidence_of(v.dependencies), DATASET)[0])


@query(
    "depends_cochange",
    """SELECT 'depends_on:' || a || ':' || b || ':cochange' AS canonical_key, 'cochange' AS kind, count(*) AS weight,
              'inferred' AS evidence_class FROM cochange GROUP BY a, b""",
)
def depends_cochange(v: Views) -> DataFrame:
    return _depends(D.depends_cochange(v.evidence_of(N.cochange_records(v.commit_rows)), DATASET)[0])


@query(
    "dangling_parents",
    """SELECT parent AS canonical_key, max(days) AS days_after_corpus_start, count(*) AS children FROM dangling GROUP BY parent""",
)
def dangling_parents(v: Views) -> DataFrame:
    """Absent parents, how far into the corpus, and how many messages answer them."""
    nodes = v.stated.nodes.kept
    claims = GAP.dangling_parents(v.stated.evidence, nodes)
    children = claims.groupBy(F.col("parent_key").alias("canonical_key")).agg(F.count("*").alias("children"))
    phantoms = GAP.dangling_phantoms(claims, nodes)
    return phantoms.join(children, "canonical_key").select("canonical_key", "days_after_corpus_start", "children")


@query("contract_gaps", "SELECT contract AS contract_id, key AS canonical_key, kind AS artifact_kind, present FROM kept")
def contract_gaps(v: Views) -> DataFrame:
    return GAP.step_status(v.contracts, v.stated.nodes.kept).select(
        "contract_id", "canonical_key", "artifact_kind", "present"
    )


@query("preceded_by", "SELECT contract AS contract_id, key AS later, previous AS earlier FROM preceded")
def preceded_by(v: Views) -> DataFrame:
    facts = GAP.preceded_by_facts(GAP.step_status(v.contracts, v.stated.nodes.kept))
    return facts.select(
        "contract_id", F.col("canonical_key").alias("later"), F.col("previous.canonical_key").alias("earlier")
    )


@query(
    "gap_evidence",
    """SELECT count(*) AS n, count(DISTINCT subject) AS phantoms FROM (
         SELECT parent AS subject, child AS o FROM dangling UNION ALL SELECT key, contract FROM kept WHERE NOT present)""",
)
def gap_evidence(v: Views) -> DataFrame:
    found = GAP.detect_gaps(v.stated.evidence, v.stated.nodes.kept, v.contracts, DATASET)
    return found.evidence.agg(
        F.count_distinct("evidence_id").alias("n"), F.count_distinct("subject_key").alias("phantoms")
    )
