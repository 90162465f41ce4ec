"""Identity: resolving source ids to handles, clustering addresses, review candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.functions.ids import short_digest
from orgweft.functions.text import bare_module, handle_stem, key_suffix, normalize_source_id
from orgweft.operators.graph import connected_components
from orgweft.operators.normalize import records_of, union_all
from orgweft.schemas import meta_struct
from orgweft.session import few, scalar, stored

# The person-id fields of each export row shape.
IDENTITY_FIELDS = {
    "slack": ("author_id", "parent_author_id", "mentions"),
    "email": ("from_id", "to_ids", "parent_author_id"),
    "ticket": ("reporter_id",),
    "git": ("author_id",),
}
LIST_FIELDS = ("mentions", "to_ids")


def handle_lookup(identity_map: DataFrame, handles: DataFrame) -> DataFrame:
    """Normalised source id -> handle.

    Mapped ids come first, then directory handles (which stand for themselves), then
    the handles the map leads to. ``identity_map`` has columns ``source_id, handle``;
    ``handles`` has ``handle``.
    """
    mapped = identity_map.select(
        normalize_source_id(F.col("source_id")).alias("source_key"), "handle", F.lit(0).alias("rank")
    )
    own = handles.select(
        normalize_source_id(F.col("handle")).alias("source_key"), "handle", F.lit(1).alias("rank")
    )
    targets = identity_map.select(
        F.col("handle").alias("source_key"), "handle", F.lit(2).alias("rank")
    )
    return (
        union_all(mapped, own, targets)
        .groupBy("source_key")
        .agg(F.min_by("handle", F.struct("rank", "handle")).alias("handle"))
    )


def unresolved_handle(source_key: Column) -> Column:
    return F.concat(F.lit("unresolved-"), handle_stem(source_key), F.lit("-"), short_digest(source_key))


def _resolve_scalar(rows: DataFrame, field: str, lookup: DataFrame) -> DataFrame:
    found = lookup.select(F.col("source_key").alias("_key"), F.col("handle").alias("_handle"))
    keyed = rows.withColumn("_key", normalize_source_id(F.col(field)))
    return (
        keyed.join(found, "_key", "left")
        .withColumn(
            field,
            F.when(
                F.col(field).isNotNull(), F.coalesce("_handle", unresolved_handle(F.col("_key")))
            ),
        )
        .drop("_key", "_handle")
    )


def _resolve_list(rows: DataFrame, field: str, lookup: DataFrame) -> DataFrame:
    """Resolve list members; the lists are rebuilt per row id, so a list is as long as its row's."""
    members = rows.select("id", F.explode(field).alias("_member")).distinct()
    resolved = (
        _resolve_scalar(members, "_member", lookup)
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("_member")).alias("_resolved"))
    )
    return (
        rows.join(resolved, "id", "left")
        .withColumn(field, F.coalesce("_resolved", F.array().cast("array<string>")))
        .drop("_resolved")
    )


def resolve_rows(rows: DataFrame, kind: str, lookup: DataFrame) -> DataFrame:
    """Map every person-id field of the export rows to a handle."""
    if kind not in IDENTITY_FIELDS:
        raise ValueError(f"unknown export kind {kind!r}")
    columns = rows.columns
    for field in IDENTITY_FIELDS[kind]:
        step = _resolve_list if field in LIST_FIELDS else _resolve_scalar
        rows = step(rows, field, lookup)
    return rows.select(*columns)


def unresolved_ids(rows: DataFrame, kind: str, lookup: DataFrame) -> DataFrame:
    """Distinct normalised ids no lookup knows, with the handle made for each."""
    frames = [
        rows.select(
            (F.explode(field) if field in LIST_FIELDS else F.col(field)).alias("raw")
        ).where("raw IS NOT NULL")
        for field in IDENTITY_FIELDS[kind]
    ]
    keys = union_all(*frames).select(normalize_source_id(F.col("raw")).alias("source_key")).distinct()
    missing = keys.join(lookup.select("source_key"), "source_key", "left_anti")
    return missing.withColumn("handle", unresolved_handle(F.col("source_key")))


def unresolved_stubs(
    unresolved: DataFrame, handles: DataFrame, *, source: str, epoch: Column
) -> DataFrame:
    """Directory records for made handles that the directory does not have."""
    new = unresolved.join(handles.select("handle"), "handle", "left_anti")
    return records_of(
        new,
        meta_struct(
            display_name=F.col("source_key"),
            role_rank=F.lit(0),
            identity_status=F.lit("unresolved"),
            source_identity=F.col("source_key"),
        ),
        source=F.lit(source),
        external_id=F.col("handle"),
        kind=F.lit("directory_person"),
        occurred_at_epoch=epoch,
        subjects=F.array(F.concat(F.lit("person:"), F.col("handle"))),
    )


def _sampled_note(names: DataFrame, column: str, shown: int, template: Column) -> DataFrame:
    """One text over distinct names: their number and the first few of them."""
    total = scalar(names, F.count("*"))
    first = names.orderBy(column).limit(shown)
    return (
        first.agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias("sample"))
        .where(F.col("sample") != "")
        .withColumn("total", total)
        .withColumn(
            "more",
            F.when(
                F.col("total") > shown,
                F.concat(F.lit(" (+"), (F.col("total") - shown).cast("string"), F.lit(" more)")),
            ).otherwise(F.lit("")),
        )
        .select(template.alias("limitation"))
    )


def unresolved_limitation(unresolved: DataFrame) -> DataFrame:
    return _sampled_note(
        unresolved.select("source_key").distinct(),
        "source_key",
        5,
        F.concat(
            F.col("total").cast("string"),
            F.lit(
                " source identities were not in the identity map and were kept as unresolved "
                "handles: "
            ),
            F.col("sample"),
            F.col("more"),
            F.lit(
                ". Ghost and Faultline results for those people are per-source-id, not per-person."
            ),
        ),
    )


# --- module references ------------------------------------------------------


def drop_unknown_modules(rows: DataFrame, known: DataFrame, id_column: str) -> DataFrame:
    """Keep only module keys the directory knows. ``known`` has column ``module``.

    With no known modules the rows are returned as they are.
    """
    fields = [f for f in ("module_keys", "dependency_keys") if f in rows.columns]
    any_known = scalar(known, F.count("*")) > 0
    columns = rows.columns
    for field in fields:
        kept = (
            rows.select(id_column, F.explode(field).alias("_key"))
            .withColumn("module", bare_module(F.col("_key")))
            .join(known.select("module").distinct(), "module")
            .groupBy(id_column)
            .agg(F.array_sort(F.collect_set("_key")).alias("_kept"))
        )
        rows = (
            rows.join(kept, id_column, "left")
            .withColumn(
                field,
                F.when(
                    any_known, F.coalesce("_kept", F.array().cast("array<string>"))
                ).otherwise(F.col(field)),
            )
            .drop("_kept")
        )
    return rows.select(*columns)


def unknown_modules(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct referenced modules that the directory does not have."""
    fields = [f for f in ("module_keys", "dependency_keys") if f in rows.columns]
    keys = union_all(*[rows.select(F.explode(f).alias("key")) for f in fields])
    bare = keys.select(bare_module(F.col("key")).alias("module")).distinct()
    some = scalar(known, F.count("*")) > 0
    return bare.join(known.select("module"), "module", "left_anti").where(some)


def module_limitation(unknown: DataFrame) -> DataFrame:
    return _sampled_note(
        unknown.select("module").distinct(),
        "module",
        8,
        F.concat(
            F.col("total").cast("string"),
            F.lit(" module references were not in the directory and were dropped: "),
            F.col("sample"),
            F.col("more"),
            F.lit("."),
        ),
    )


# --- clustering -------------------------------------------------------------


def normalize_person_name(name: Column) -> Column:
    """Accent-folded lower-case words; a single word is too ambiguous and gives an empty name."""
    from orgweft.functions.names import fold_accents

    plain = F.regexp_replace(fold_accents(F.coalesce(name, F.lit(""))), r"\(.*?\)", "")
    words = F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))
    return F.when(F.contains(words, F.lit(" ")), words).otherwise(F.lit(""))


def observation_counts(observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``name, email, ticket_user``: counts per email, per (email, name), per ticket user."""
    seen = observations.where("email IS NOT NULL").withColumn(
        "name_key", normalize_person_name(F.col("name"))
    )
    emails = seen.groupBy("email").agg(F.count("*").alias("n"))
    names = (
        seen.where("name_key <> ''")
        .groupBy("email", "name_key")
        .agg(F.count("*").alias("n"), F.max_by("name", F.struct(F.length("name"), "name")).alias("display"))
    )
    users = (
        observations.where("ticket_user IS NOT NULL")
        .groupBy(F.lower("ticket_user").alias("ticket_user"))
        .agg(F.count("*").alias("n"))
    )
    return emails, names, users


def identity_clusters(emails: DataFrame, names: DataFrame) -> DataFrame:
    """(email, cluster): emails that share an exact normalised name are one person, transitively.

    Each email is tied to the smallest email of its name, so a name shared by very many
    emails gives a star and not all their pairs.
    """
    anchors = names.groupBy("name_key").agg(F.min("email").alias("anchor"))
    ties = names.join(anchors, "name_key").where("email <> anchor").select(
        F.col("email").alias("a"), F.col("anchor").alias("b")
    ).distinct()
    return connected_components(emails.select(F.col("email").alias("v")), ties).select(
        F.col("v").alias("email"), F.col("component").alias("cluster")
    )


def safe_handle(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(value), r"[^a-z0-9._-]+", "-")
    return F.coalesce(
        F.nullif(F.regexp_replace(dashed, r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("person")
    )


def cluster_handles(
    clusters: DataFrame,
    emails: DataFrame,
    names: DataFrame,
    roster_names: DataFrame,
    org_domain: str,
) -> DataFrame:
    """(cluster, handle, display).

    The handle is the organisation address's local part, else the roster id of the
    commonest roster name, else the local part of the commonest address. ``roster_names``
    has ``name_key, roster_id``.
    """
    counted = clusters.join(emails, "email")
    order = F.struct((-F.col("n")).alias("n"), "email")
    local = F.substring_index("email", "@", 1)
    by_email = counted.groupBy("cluster").agg(
        F.min_by(local, order).alias("common"),
        F.min_by(
            F.when(F.endswith("email", F.lit("@" + org_domain)), local),
            F.when(F.endswith("email", F.lit("@" + org_domain)), order),
        ).alias("org_id"),
    )
    by_name = (
        clusters.join(names, "email")
        .groupBy("cluster", "name_key")
        .agg(F.sum("n").alias("n"), F.max_by("display", F.struct(F.length("display"), "display")).alias("display"))
    )
    pick = F.struct((-F.col("n")).alias("n"), "name_key")
    listed = by_name.join(roster_names, "name_key").groupBy("cluster").agg(
        F.min_by("roster_id", pick).alias("roster_id")
    )
    shown = by_name.groupBy("cluster").agg(F.min_by("display", pick).alias("display"))
    handle = safe_handle(F.coalesce("org_id", "roster_id", "common"))
    return (
        by_email.join(listed, "cluster", "left")
        .join(shown, "cluster", "left")
        .withColumn("handle", handle)
        .select("cluster", "handle", F.coalesce("display", "handle").alias("display"))
    )


def merge_by_handle(handles: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters with one handle are one person: (email, handle) and (handle, display).

    The cluster with the smallest name gives the display name.
    """
    identity = clusters.join(handles, "cluster").select("email", "handle")
    people = handles.groupBy("handle").agg(F.min_by("display", "cluster").alias("display"))
    return identity, people


# Ranks of the published roster.
ROLE_OWNER, ROLE_MEMBER, ROLE_CONTRIBUTOR = 4, 3, 1


def roster_ranks(members: DataFrame, owners: DataFrame) -> DataFrame:
    """(roster_id, role_rank): members 3, owners 4."""
    both = union_all(
        members.select(F.lower("roster_id").alias("roster_id"), F.lit(ROLE_MEMBER).alias("role_rank")),
        owners.select(F.lower("roster_id").alias("roster_id"), F.lit(ROLE_OWNER).alias("role_rank")),
    )
    return both.groupBy("roster_id").agg(F.max("role_rank").alias("role_rank"))


def person_ranks(people: DataFrame, roster: DataFrame) -> DataFrame:
    ranked = people.join(roster.withColumnRenamed("roster_id", "handle"), "handle", "left")
    return ranked.withColumn("role_rank", F.coalesce("role_rank", F.lit(ROLE_CONTRIBUTOR)))


def ticket_only_people(users: DataFrame, identity: DataFrame) -> DataFrame:
    """Ticket users that no address or handle accounts for: (ticket_user, handle)."""
    known = union_all(
        identity.select(F.col("email").alias("name")), identity.select(F.col("handle").alias("name"))
    ).distinct()
    fresh = users.select("ticket_user", safe_handle(F.col("ticket_user")).alias("handle"))
    return (
        fresh.join(known.withColumnRenamed("name", "ticket_user"), "ticket_user", "left_anti")
        .join(known.withColumnRenamed("name", "handle"), "handle", "left_anti")
        .groupBy("handle")
        .agg(F.min("ticket_user").alias("ticket_user"))
        .select("ticket_user", "handle")
    )


# --- merge candidates -------------------------------------------------------


def candidate_members(nodes: DataFrame) -> DataFrame:
    """Members of each proposed merge, one row per person, groups of two or more only."""
    members = nodes.where(
        (F.col("label") == "Person") & F.col("props.identity_candidate_id").isNotNull()
    ).select(
        F.col("props.identity_candidate_id").alias("candidate_id"),
        F.col("canonical_key").alias("person_key"),
        F.coalesce("props.display_name", key_suffix(F.col("canonical_key"))).alias("display_name"),
        F.coalesce("props.source_identity", "canonical_key").alias("source_identity"),
        F.coalesce("props.identity_source", F.lit("unknown")).alias("source_type"),
        F.coalesce("props.identity_primary", F.lit(False)).alias("is_primary"),
        F.col("props.identity_confidence").alias("confidence"),
        F.col("props.identity_signal").alias("signal"),
    )
    sizes = members.groupBy("candidate_id").agg(F.count("*").alias("size")).where("size >= 2")
    return members.join(sizes.select("candidate_id"), "candidate_id", "left_semi")


def identity_candidates(nodes: DataFrame, edges: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One row per proposed merge; its members stay in ``candidate_members``.

    Edge effects: every edge that touches the group, and how many of them become equal
    once the members are one person.
    """
    members = candidate_members(nodes)
    summary = members.groupBy("candidate_id").agg(
        F.min_by(
            F.struct("person_key", "display_name"), F.struct(~F.col("is_primary"), "person_key")
        ).alias("first"),
        F.coalesce(F.min("confidence"), F.lit(0)).alias("confidence"),
        F.array_sort(F.collect_set("signal")).alias("signals"),
        F.count("*").alias("members"),
    )
    group = few(stored(members.select("person_key", "candidate_id"), "members"))
    ends = edges.select(
        F.col("canonical_key").alias("edge_key"),
        "rel_type",
        "source_key",
        "target_key",
        F.explode(F.array("source_key", "target_key")).alias("person_key"),
    )
    marker = F.lit("candidate")
    touched = (
        ends.join(group, "person_key")
        .groupBy("candidate_id", "edge_key", "rel_type", "source_key", "target_key")
        .agg(
            F.max(F.when(F.col("person_key") == F.col("source_key"), True)).alias("source_in"),
            F.max(F.when(F.col("person_key") == F.col("target_key"), True)).alias("target_in"),
        )
        .select(
            "candidate_id",
            "edge_key",
            "rel_type",
            F.when(F.col("source_in"), marker).otherwise(F.col("source_key")).alias("s"),
            F.when(F.col("target_in"), marker).otherwise(F.col("target_key")).alias("t"),
        )
    )
    relations = touched.groupBy("candidate_id", "rel_type", "s", "t").agg(F.count("*").alias("n"))
    effects = relations.groupBy("candidate_id").agg(
        F.sum("n").alias("affected"), (F.sum("n") - F.count("*")).alias("duplicates")
    )
    out = summary.join(effects, "candidate_id", "left").select(
        "candidate_id",
        F.col("first.person_key").alias("proposed_person_key"),
        F.col("first.display_name").alias("proposed_display_name"),
        "confidence",
        "signals",
        "members",
        (F.col("members") - 1).alias("projected_node_reduction"),
        F.coalesce("affected", F.lit(0)).alias("affected_edge_count"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicate_relationships_removed"),
    )
    return overlay_decisions(out, decisions)


def overlay_decisions(candidates: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Status per candidate: its latest decision (``candidate_id, status, decided_at``) or pending."""
    if decisions is None:
        return candidates.withColumn("status", F.lit("pending"))
    latest = decisions.groupBy("candidate_id").agg(
        F.max_by("status", F.struct("decided_at", "status")).alias("status")
    )
    return candidates.join(latest, "candidate_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )
