"""Canonical records to evidence, nodes and observed edges, with provenance as link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orgweft.functions.ids import DEFAULT_PERSON, edge_id_payload, path_key, stable_id
from orgweft.functions.text import (
    edge_key,
    json_array,
    json_object,
    json_text,
    key_suffix,
    percent_quote,
)
from orgweft.operators.normalize import union_all
from orgweft.schemas import (
    EDGE_COLUMNS,
    EVIDENCE_COLUMNS,
    LABEL_OF_KIND,
    NODE_COLUMNS,
    NODE_PREFIX,
    edge_props,
    node_props,
)
from orgweft.session import few


def payload_json() -> Column:
    """The whole record as canonical JSON: sorted keys, compact, raw UTF-8."""
    return json_object(
        author_external_id=json_text(F.col("author_external_id")),
        content=json_text(F.col("content")),
        content_sha256=json_text(F.col("content_sha256")),
        external_id=json_text(F.col("external_id")),
        kind=json_text(F.col("kind")),
        metadata=F.col("metadata_json"),
        occurred_at_epoch=F.col("occurred_at_epoch").cast("string"),
        parent_external_id=json_text(F.col("parent_external_id")),
        source=json_text(F.col("source")),
        subjects=json_array(F.col("subjects")),
    )


def _mark(df: DataFrame, names: list[str]) -> Column:
    """A hash of columns, those of structs one by one. Nulls do not count in such a hash, so
    their places are hashed as well.
    """
    flat = []
    for name in names:
        kind = df.schema[name].dataType
        flat += [F.col(f"{name}.{f}") for f in kind.names] if isinstance(kind, StructType) else [F.col(name)]
    return F.xxhash64(*flat, F.array(*[c.isNull() for c in flat]))


def reduced(df: DataFrame, keys: list[str], content: list[str], rule: str, by_field: bool = False) -> DataFrame:
    """One row per key with ``rule`` set where rows of the key differ in their content.

    Copies are reduced in each task before the shuffle, so a key with very many is few rows there.
    ``by_field`` reduces structs field by field, for results of which few columns are read.
    """
    marked = df.withColumn("mark", _mark(df, content))
    if by_field:
        marked = _by_field(marked)
    others = [name for name in marked.columns if name not in (*keys, "mark")]
    reduced = marked.groupBy(*keys).agg(
        *[F.first(f"`{name}`").alias(name) for name in others],
        F.when(F.min("mark") != F.max("mark"), F.lit(rule)).alias("rule"),
    )
    return _whole(reduced, df) if by_field else reduced.select(*df.columns, "rule")


def _by_field(df: DataFrame) -> DataFrame:
    """Structs as one column per field; what nobody reads is then not shuffled."""
    flat = []
    for field in df.schema:
        names = field.dataType.names if isinstance(field.dataType, StructType) else None
        flat += [F.col(field.name)] if names is None else [F.col(f"{field.name}.{f}").alias(f"{field.name}.{f}") for f in names]
    return df.select(*flat)


def _whole(df: DataFrame, like: DataFrame) -> DataFrame:
    """The structs of ``like`` put together again."""
    columns = []
    for field in like.schema:
        if isinstance(field.dataType, StructType):
            parts = [F.col(f"`{field.name}.{f}`").alias(f) for f in field.dataType.names]
            columns.append(F.struct(*parts).alias(field.name))
        else:
            columns.append(F.col(field.name))
    kept = [name for name in df.columns if name not in like.columns and "." not in name]
    return df.select(*columns, *kept)


def deduplicate(records: DataFrame) -> DataFrame:
    """One row per (source, external id). Copies are reduced in each task before the shuffle."""
    return _whole(_by_field(records).dropDuplicates(["source", "external_id"]), records)


RECORD_CONFLICT = "record is stated in different ways"
NODE_CONFLICT = "node is stated in different ways"
EDGE_CONFLICT = "edge is stated in different ways"

# What the payload of a record holds.
PAYLOAD = [
    "author_external_id",
    "content",
    "content_sha256",
    "external_id",
    "kind",
    "metadata_json",
    "occurred_at_epoch",
    "parent_external_id",
    "source",
    "subjects",
]


def reduced_records(records: DataFrame, by_field: bool = False) -> DataFrame:
    """``deduplicate`` with ``rule`` set for identities whose copies have different payloads."""
    return reduced(records, ["source", "external_id"], PAYLOAD, RECORD_CONFLICT, by_field)


def conflicting_records(records: DataFrame) -> DataFrame:
    """Source identities whose copies do not have the same payload."""
    hashed = records.select("source", "external_id", F.sha2(payload_json(), 256).alias("payload"))
    return (
        hashed.groupBy("source", "external_id")
        .agg(F.count("*").alias("copies"), F.min("payload").alias("a"), F.max("payload").alias("b"))
        .where("a <> b")
        .select("source", "external_id", "copies")
    )


def evidence_of(records: DataFrame, dataset_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One evidence row per record; ``meta`` and the parent stay as typed columns beside it."""
    digest = F.sha2(F.concat(F.lit(f"{dataset_id}|evidence|"), payload_json()), 256)
    fallback = F.concat(F.lit("record:"), F.col("source"), F.lit(":"), F.col("external_id"))
    subject = F.coalesce(F.try_element_at("subjects", F.lit(1)), fallback)
    inferred = F.col("kind").isin("cochange", "inferred_coupling") | (
        F.coalesce(F.col("meta.relationship_class"), F.lit("")) == "inferred_coupling"
    )
    metadata = json_object(
        author_external_id=json_text(F.col("author_external_id")),
        metadata=F.col("metadata_json"),
        parent_external_id=json_text(F.col("parent_external_id")),
        subjects=json_array(F.col("subjects")),
    )
    values = {
        "evidence_id": F.concat(F.lit("evidence:"), digest),
        "run_id": F.lit(f"canonicalize:{dataset_id}"),
        "source_type": F.col("source"),
        "source_uri": F.concat(
            F.lit("record://"),
            percent_quote(F.col("source")),
            F.lit("/"),
            percent_quote(F.col("external_id")),
        ),
        "source_record_id": F.col("external_id"),
        "observed_epoch": F.col("occurred_at_epoch"),
        "subject_key": subject,
        "predicate": F.col("kind"),
        "object_key": F.coalesce(F.try_element_at("subjects", F.lit(2)), subject),
        "evidence_class": F.coalesce(
            F.col("meta.evidence_class"),
            F.when(inferred, F.lit("inferred")).otherwise(F.lit("observed")),
        ),
        "confidence": F.lit(100),
        "extraction_method": F.lit("canonical_record"),
        "content_sha256": F.col("content_sha256"),
        "redacted_excerpt": F.when(F.col("content").isNull(), F.lit("")).otherwise(
            F.lit("[content redacted]")
        ),
        "metadata_json": metadata,
    }
    return records.select(
        *[values[name].alias(name) for name in EVIDENCE_COLUMNS],
        F.col("meta"),
        F.col("parent_external_id"),
        F.col("subjects"),
        F.col("author_external_id"),
        *keep,
    )


def node_label() -> Column:
    label = F.lit(None).cast("string")
    for kind, name in LABEL_OF_KIND.items():
        label = F.when(F.col("predicate") == kind, F.lit(name)).otherwise(label)
    return label


def node_key(label: Column) -> Column:
    """Configured key, else the first subject with the label's prefix, else prefix + id."""
    prefix = F.create_map(*[F.lit(x) for pair in NODE_PREFIX.items() for x in pair])[label]
    matching = F.filter("subjects", lambda s: F.startswith(s, prefix))
    return F.coalesce(
        F.col("meta.canonical_key"),
        F.try_element_at(matching, F.lit(1)),
        F.concat(prefix, F.col("source_record_id")),
    )


def _props_of_record(label: Column) -> Column:
    meta = lambda name: F.col(f"meta.{name}")
    on = lambda name, value: F.when(label == name, value)
    external = F.col("source_record_id")
    person = {
        name: on("Person", meta(name))
        for name in (
            "display_name",
            "role_rank",
            "identity_status",
            "source_identity",
            "identity_candidate_id",
            "identity_confidence",
            "identity_primary",
            "identity_signal",
            "identity_source",
        )
    }
    return node_props(
        **person,
        handle=on("Person", external),
        team_id=on("Person", meta("team_key")),
        parent_team_id=on("Team", meta("parent_team_id")),
        created_epoch=on("Artifact", F.col("observed_epoch")),
        ext_ref=on("Artifact", external),
        source_type=on("Artifact", F.col("source_type")),
        kind=on("Artifact", meta("artifact_kind")),
        thread_seq=on("Artifact", meta("sequence_ordinal")),
        criticality=on("Module", meta("criticality")),
        language=on("Module", meta("language")),
        repo=on("Module", meta("repo")),
        name=F.when(label == "Team", external).when(
            label == "Module", F.coalesce(meta("module_name"), external)
        ),
    )


def node_candidates(evidence: DataFrame, dataset_id: str, person: bytes = DEFAULT_PERSON) -> DataFrame:
    """One row per record that states a node, before equal nodes are merged."""
    labelled = evidence.withColumn("label", node_label()).where("label IS NOT NULL")
    keyed = labelled.withColumn("canonical_key", node_key(F.col("label")))
    return keyed.select(
        stable_id(dataset_id, F.col("label"), F.col("canonical_key"), person=person).alias("id"),
        "canonical_key",
        "label",
        "evidence_class",
        F.lit(100).alias("confidence"),
        _props_of_record(F.col("label")).alias("props"),
        "evidence_id",
    )


# What the statements of a node or edge must agree in.
NODE_CONTENT = ["label", "evidence_class", "confidence", "props"]
EDGE_CONTENT = ["source_key", "target_key", "evidence_class", "props"]


def node_statements(candidates: DataFrame) -> DataFrame:
    """Candidates as nodes, one per record."""
    return candidates.withColumn("path_key", path_key(F.col("label"), F.col("id"))).select(*NODE_COLUMNS)


def node_links(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        F.col("id").alias("node_id"), F.col("canonical_key").alias("node_key"), "evidence_id"
    ).distinct()


def conflicting_candidates(candidates: DataFrame) -> DataFrame:
    """Keys stated with different content (evidence ids aside)."""
    content = [
        c for c in candidates.columns if c not in ("evidence_id", "canonical_key", "id")
        and not c.endswith("_id")
    ]
    hashed = candidates.select(
        "canonical_key", F.xxhash64(*[F.to_json(c) if c == "props" else F.col(c) for c in content]).alias("h")
    )
    return (
        hashed.groupBy("canonical_key")
        .agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("statements"))
        .where("a <> b")
        .select("canonical_key", "statements")
    )


# --- edges ------------------------------------------------------------------

ARTIFACT = "artifact:"


def label_of_key(key: Column) -> Column:
    prefix = F.substring_index(key, ":", 1)
    return (
        F.when(prefix == "person", F.lit("Person"))
        .when(prefix == "team", F.lit("Team"))
        .when(prefix == "module", F.lit("Module"))
        .otherwise(F.lit("Artifact"))
    )


def edge_frame(
    df: DataFrame,
    dataset_id: str,
    rel_type: str,
    *,
    discriminator: Column,
    canonical_key: Column,
    props: Column,
    evidence_class: Column,
    confidence: int = 100,
    target_label: Column | None = None,
    source_label: Column | None = None,
    keep: tuple[str, ...] = (),
    person: bytes = DEFAULT_PERSON,
) -> DataFrame:
    """Edges from ``source_key`` and ``target_key``.

    Ids follow from the keys, so no join with the nodes is needed; that the endpoints
    exist is a separate check.
    """
    source, target = F.col("source_key"), F.col("target_key")
    ids = df.withColumn(
        "source_id",
        stable_id(dataset_id, source_label if source_label is not None else label_of_key(source), source, person=person),
    ).withColumn(
        "target_id",
        stable_id(dataset_id, target_label if target_label is not None else label_of_key(target), target, person=person),
    )
    payload = edge_id_payload(F.col("source_id"), F.col("target_id"), discriminator)
    values = {
        "id": stable_id(dataset_id, rel_type, payload, person=person),
        "canonical_key": canonical_key,
        "source_id": F.col("source_id"),
        "target_id": F.col("target_id"),
        "source_key": source,
        "target_key": target,
        "rel_type": F.lit(rel_type),
        "evidence_class": evidence_class,
        "confidence": F.lit(confidence),
        "props": props,
    }
    return ids.select(*[values[name].alias(name) for name in EDGE_COLUMNS], *keep)


def _observed(
    facts: DataFrame, dataset_id: str, rel_type: str, name: str, what: str, merged: bool = False, **kw
) -> DataFrame:
    """Edges of facts, one per fact with its evidence, or ``merged``: one per key with its ``rule``.

    All of an edge follows from four columns of its fact, so only these are merged, and the edge is
    built afterwards.
    """
    if merged:
        key = F.concat_ws(":", F.lit(name), key_suffix(F.col("source_key")), key_suffix(F.col("target_key")))
        narrow = facts.select(key.alias("key"), *OBSERVED_FACT)
        facts = reduced(narrow, ["key"], list(OBSERVED_FACT), EDGE_CONFLICT)
    return edge_frame(
        facts,
        dataset_id,
        rel_type,
        discriminator=F.lit(what),
        canonical_key=F.concat_ws(
            ":", F.lit(name), key_suffix(F.col("source_key")), key_suffix(F.col("target_key"))
        ),
        props=edge_props(observed_epoch=F.col("observed_epoch")),
        evidence_class=F.col("evidence_class"),
        keep=("rule",) if merged else ("evidence_id",),
        **kw,
    )


OBSERVED_FACT = ("source_key", "target_key", "observed_epoch", "evidence_class")


def _artifact_facts(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("predicate") == "artifact").withColumn(
        "artifact_key", node_key(F.lit("Artifact"))
    )


def reports_to(evidence: DataFrame, dataset_id: str, **kw) -> DataFrame:
    facts = evidence.where(
        (F.col("predicate") == "directory_person") & F.col("meta.manager_external_id").isNotNull()
    ).select(
        node_key(F.lit("Person")).alias("source_key"),
        F.concat(F.lit("person:"), F.col("meta.manager_external_id")).alias("target_key"),
        "observed_epoch",
        "evidence_class",
        "evidence_id",
    )
    return _observed(facts, dataset_id, "REPORTS_TO", "reporting", "reporting_line", **kw)


def authored(evidence: DataFrame, dataset_id: str, **kw) -> DataFrame:
    facts = _artifact_facts(evidence).where("author_external_id IS NOT NULL").select(
        F.concat(F.lit("person:"), F.col("author_external_id")).alias("source_key"),
        F.col("artifact_key").alias("target_key"),
        "observed_epoch",
        "evidence_class",
        "evidence_id",
    )
    return _observed(facts, dataset_id, "AUTHORED", "authorship", "authored", **kw)


def about(evidence: DataFrame, dataset_id: str, **kw) -> DataFrame:
    modules = F.array_distinct(F.filter("subjects", lambda s: F.startswith(s, F.lit("module:"))))
    facts = _artifact_facts(evidence).select(
        F.col("artifact_key").alias("source_key"),
        F.explode(modules).alias("target_key"),
        "observed_epoch",
        "evidence_class",
        "evidence_id",
    )
    return _observed(facts, dataset_id, "ABOUT", "about", "about", **kw)


def parent_key() -> Column:
    parent = F.col("parent_external_id")
    return F.when(F.startswith(parent, F.lit("artifact:")), parent).otherwise(
        F.concat(F.lit("artifact:"), F.col("source_type"), F.lit(":"), parent)
    )


def replies_to(evidence: DataFrame, dataset_id: str, nodes: DataFrame, **kw) -> DataFrame:
    """Replies whose parent is a node; the others are gap findings."""
    facts = _artifact_facts(evidence).where("parent_external_id IS NOT NULL").select(
        F.col("artifact_key").alias("source_key"),
        parent_key().alias("target_key"),
        "observed_epoch",
        "evidence_class",
        "evidence_id",
    )
    known = nodes.select(F.col("canonical_key").alias("target_key"))
    present = facts.join(known, "target_key", "left_semi")
    return _observed(present, dataset_id, "REPLIES_TO", "replies_to", "thread_parent", **kw)


def observed_edge_candidates(
    evidence: DataFrame, nodes: DataFrame, dataset_id: str, person: bytes = DEFAULT_PERSON, merged: bool = False
) -> DataFrame:
    """Edges that records state, one per record, or ``merged``: one per key, with ``rule`` set for
    keys stated with different content.
    """
    return union_all(
        reports_to(evidence, dataset_id, person=person, merged=merged),
        authored(evidence, dataset_id, person=person, merged=merged),
        about(evidence, dataset_id, person=person, merged=merged),
        replies_to(evidence, dataset_id, nodes, person=person, merged=merged),
    )


def absent_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key``: endpoints that are no nodes, each once."""
    ends = edges.select(F.explode(F.array("source_key", "target_key")).alias("key")).distinct()
    return ends.join(nodes.select(F.col("canonical_key").alias("key")), "key", "left_anti")


def with_endpoint_rule(edges: DataFrame, nodes: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """Edges with ``rule`` set where an endpoint is no node; a rule that is set stays.

    With the stored ``absent_endpoints`` the edges are joined to those, which are few as a rule,
    and not to all nodes.
    """
    if absent is not None:
        missing = F.col("source_key").isNull() | F.col("target_key").isNull()
        for end in ("source", "target"):
            gone = absent.select(F.col("key").alias(f"{end}_key"), F.lit(True).alias(f"{end}_gone"))
            edges = edges.join(gone, f"{end}_key", "left")
            missing = missing | F.col(f"{end}_gone").isNotNull()
        return edges.withColumn("rule", F.coalesce("rule", F.when(missing, F.lit("endpoint is missing")))).select(
            *EDGE_COLUMNS, "rule"
        )
    known = nodes.select(F.col("canonical_key").alias("key"), F.lit(True).alias("there"))
    return _with_known_ends(edges, known)


def with_near_endpoint_rule(edges: DataFrame, nodes: DataFrame, near: DataFrame, rel_type: str) -> DataFrame:
    """``with_endpoint_rule`` with ``near``, the nodes whose keys are not those of artifacts.

    Only edges at artifacts are joined to all nodes; communication is between people.
    """
    known = lambda df: df.select(F.col("canonical_key").alias("key"), F.lit(True).alias("there"))
    if rel_type == "COMMUNICATES":
        return _with_known_ends(edges, known(near))
    far = F.startswith("source_key", F.lit(ARTIFACT)) | F.startswith("target_key", F.lit(ARTIFACT))
    at_artifact = F.coalesce(far, F.lit(False))
    return _with_known_ends(edges.where(~at_artifact), known(near)).unionByName(
        _with_known_ends(edges.where(at_artifact), known(nodes))
    )


def near_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.startswith("canonical_key", F.lit(ARTIFACT)))


def _with_known_ends(edges: DataFrame, known: DataFrame) -> DataFrame:
    for end in ("source", "target"):
        present = known.withColumnsRenamed({"key": f"{end}_key", "there": f"{end}_there"})
        edges = edges.join(present, f"{end}_key", "left")
    missing = F.col("source_there").isNull() | F.col("target_there").isNull()
    return edges.withColumn("rule", F.coalesce("rule", F.when(missing, F.lit("endpoint is missing")))).select(
        *EDGE_COLUMNS, "rule"
    )


def edge_links(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        F.col("id").alias("edge_id"), F.col("canonical_key").alias("edge_key"), "evidence_id"
    ).distinct()


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge, endpoint) pairs whose endpoint is not a node."""
    ends = edges.select(
        F.col("canonical_key").alias("edge_key"),
        F.explode(F.array("source_key", "target_key")).alias("canonical_key"),
    )
    at_artifact = F.coalesce(F.startswith("canonical_key", F.lit(ARTIFACT)), F.lit(False))
    keys = nodes.select("canonical_key")
    return ends.where(~at_artifact).join(few(near_nodes(keys)), "canonical_key", "left_anti").unionByName(
        ends.where(at_artifact).join(keys.where(at_artifact), "canonical_key", "left_anti")
    )
