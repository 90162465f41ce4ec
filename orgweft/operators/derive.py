"""Derived edges: communication, ownership, dependency.

Each operator returns (edges, links). ``links`` holds one row per edge and supporting
evidence record, so the provenance of a hot pair stays spread over many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.functions.ids import DEFAULT_PERSON
from orgweft.functions.ranking import top_per_group
from orgweft.functions.text import edge_key, half_even
from orgweft.operators.canonicalize import edge_frame
from orgweft.operators.normalize import union_all
from orgweft.schemas import edge_props

# Fixed values of the derivation rules.
INTERACTION_KINDS = ("mention", "reply", "email")
DEPENDENCY_KINDS = ("import", "manifest", "runtime_call", "explicit_reference")
OWNERS_PER_MODULE = 3

Derived = tuple[DataFrame, DataFrame]


def _keyed(rel_type: str, tail: Column) -> Column:
    return edge_key(rel_type, F.col("source_key"), F.col("target_key"), tail)


def _links(edges: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    keys = edges.select(F.col("id").alias("edge_id"), F.col("canonical_key").alias("edge_key"), *on)
    return facts.select(*on, "evidence_id").join(keys, on).select(
        "edge_id", "edge_key", "evidence_id"
    )


def _claims(
    facts: DataFrame, dataset_id: str, rel_type: str, tail: Column, person: bytes
) -> DataFrame:
    """Links of facts to the edge their keys lead to; no join is needed."""
    edges = edge_frame(
        facts,
        dataset_id,
        rel_type,
        discriminator=tail,
        canonical_key=_keyed(rel_type, tail),
        props=F.lit(None),
        evidence_class=F.lit(None),
        keep=("evidence_id",),
        person=person,
    )
    return edges.select(
        F.col("id").alias("edge_id"), F.col("canonical_key").alias("edge_key"), "evidence_id"
    )


def communication_facts(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("predicate") == "communication_aggregate").select(
        F.concat(F.lit("person:"), F.col("meta.sender_external_id")).alias("source_key"),
        F.concat(F.lit("person:"), F.col("meta.recipient_external_id")).alias("target_key"),
        F.col("meta.interaction_kind").alias("kind"),
        F.col("meta.interaction_count").alias("n"),
        F.col("meta.first_epoch").alias("first_epoch"),
        F.col("meta.last_epoch").alias("last_epoch"),
        "evidence_id",
    )


def communicates(evidence: DataFrame, dataset_id: str, person: bytes = DEFAULT_PERSON) -> Derived:
    """Directed COMMUNICATES: weight per interaction kind, first and last epoch."""
    facts = communication_facts(evidence)
    weight = lambda kind: F.sum(
        F.when(F.col("kind") == kind, F.col("n")).otherwise(F.lit(0))
    )
    sums = facts.groupBy("source_key", "target_key").agg(
        weight("mention").alias("mention_weight"),
        weight("reply").alias("reply_weight"),
        weight("email").alias("email_weight"),
        F.min("first_epoch").alias("first_epoch"),
        F.max("last_epoch").alias("last_epoch"),
    )
    edges = edge_frame(
        sums,
        dataset_id,
        "COMMUNICATES",
        discriminator=F.lit("aggregate"),
        canonical_key=_keyed("COMMUNICATES", F.lit("aggregate")),
        props=edge_props(
            first_epoch=F.col("first_epoch"),
            last_epoch=F.col("last_epoch"),
            mention_weight=F.col("mention_weight"),
            reply_weight=F.col("reply_weight"),
            email_weight=F.col("email_weight"),
            weight=F.expr("mention_weight + reply_weight + email_weight"),
        ),
        evidence_class=F.lit("inferred"),
        person=person,
    )
    return edges, _claims(
        facts, dataset_id, "COMMUNICATES", F.lit("aggregate"), person
    )


def owns_aggregate(evidence: DataFrame, dataset_id: str, person: bytes = DEFAULT_PERSON) -> Derived:
    """OWNS from stated authorship counts; confidence is the share, ties to even."""
    facts = evidence.where(F.col("predicate") == "authorship_aggregate").select(
        F.col("subject_key").alias("source_key"),
        F.col("object_key").alias("target_key"),
        F.col("meta.attributed_count").alias("attributed"),
        F.col("meta.total_attributed_count").alias("total"),
        "evidence_id",
    )
    edges = edge_frame(
        facts,
        dataset_id,
        "OWNS",
        discriminator=F.lit("authorship_density"),
        canonical_key=_keyed("OWNS", F.lit("authorship_density")),
        props=edge_props(
            attributed_count=F.col("attributed"),
            confidence=half_even(F.col("attributed") / F.col("total") * 100),
            total_attributed_count=F.col("total"),
        ),
        evidence_class=F.lit("inferred"),
        keep=("evidence_id",),
        person=person,
    )
    return _split(edges)


def _split(edges: DataFrame) -> Derived:
    links = edges.select(
        F.col("id").alias("edge_id"), F.col("canonical_key").alias("edge_key"), "evidence_id"
    )
    return edges.drop("evidence_id"), links


def owns_assertion(evidence: DataFrame, dataset_id: str, person: bytes = DEFAULT_PERSON) -> Derived:
    """OWNS stated by a source with an authority and a validity window; one edge per record."""
    facts = evidence.where(F.col("predicate") == "ownership_assertion").select(
        F.col("subject_key").alias("source_key"),
        F.col("object_key").alias("target_key"),
        "meta",
        "observed_epoch",
        "source_record_id",
        "evidence_class",
        "evidence_id",
    )
    tail = F.concat(F.lit("assertion:"), F.col("source_record_id"))
    edges = edge_frame(
        facts,
        dataset_id,
        "OWNS",
        discriminator=tail,
        canonical_key=_keyed("OWNS", tail),
        props=edge_props(
            authority=F.col("meta.authority"),
            authority_rank=F.col("meta.authority_rank"),
            confidence=F.col("meta.confidence"),
            observed_epoch=F.col("observed_epoch"),
            owner_rank=F.lit(1),
            source_record_id=F.col("source_record_id"),
            valid_from_epoch=F.col("meta.valid_from_epoch"),
            valid_until_epoch=F.col("meta.valid_until_epoch"),
        ),
        evidence_class=F.col("evidence_class"),
        keep=("evidence_id",),
        person=person,
    )
    return _split(edges)


def authorship_shares(evidence: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts per (module, author) for modules without stated counts, and the joined facts.

    An artifact's author is that of its AUTHORED edge with the greatest id.
    """
    stated = evidence.where(F.col("predicate") == "authorship_aggregate").select(
        F.col("object_key").alias("module_key")
    )
    authors = (
        edges.where(F.col("rel_type") == "AUTHORED")
        .groupBy(F.col("target_key").alias("artifact_key"))
        .agg(
            F.max_by(
                F.struct("source_key", F.col("canonical_key").alias("authored_key")),
                F.struct("id", "canonical_key"),
            ).alias("a")
        )
        .select("artifact_key", F.col("a.source_key").alias("author_key"), "a.authored_key")
    )
    subjects = edges.where(F.col("rel_type") == "ABOUT").select(
        F.col("source_key").alias("artifact_key"),
        F.col("target_key").alias("module_key"),
        F.col("canonical_key").alias("about_key"),
    )
    joined = subjects.join(stated, "module_key", "left_anti").join(authors, "artifact_key")
    counts = joined.groupBy("module_key", "author_key").agg(F.count("*").alias("attributed"))
    return counts, joined


def owns_density(
    evidence: DataFrame,
    edges: DataFrame,
    links: DataFrame,
    dataset_id: str,
    person: bytes = DEFAULT_PERSON,
) -> Derived:
    """OWNS from AUTHORED and ABOUT: the three authors with most artifacts of each module."""
    counts, joined = authorship_shares(evidence, edges)
    totals = counts.groupBy("module_key").agg(F.sum("attributed").alias("total"))
    ranked = top_per_group(
        counts,
        ["module_key"],
        [F.desc("attributed"), F.asc("author_key")],
        OWNERS_PER_MODULE,
        "owner_rank",
    ).join(totals, "module_key")
    share = half_even(F.col("attributed") / F.col("total") * 100)
    owned = edge_frame(
        ranked.withColumnsRenamed({"author_key": "source_key", "module_key": "target_key"}),
        dataset_id,
        "OWNS",
        discriminator=F.lit("authorship_density_derived"),
        canonical_key=_keyed("OWNS", F.lit("authorship_density_derived")),
        props=edge_props(
            attributed_count=F.col("attributed"),
            confidence=F.greatest(F.lit(1), F.least(F.lit(100), share)),
            owner_rank=F.col("owner_rank"),
            total_attributed_count=F.col("total"),
        ),
        evidence_class=F.lit("inferred"),
        person=person,
    )
    support = (
        joined.withColumnsRenamed({"author_key": "source_key", "module_key": "target_key"})
        .select(
            "source_key", "target_key", F.explode(F.array("authored_key", "about_key")).alias("edge_key")
        )
        .join(links.select("edge_key", "evidence_id"), "edge_key")
        .select("source_key", "target_key", "evidence_id")
        .distinct()
    )
    return owned, _links(owned, support, ["source_key", "target_key"])


def depends_explicit(evidence: DataFrame, dataset_id: str, person: bytes = DEFAULT_PERSON) -> Derived:
    """DEPENDS_ON as declared; one edge per record."""
    facts = evidence.where(F.col("predicate") == "dependency").select(
        F.col("subject_key").alias("source_key"),
        F.col("object_key").alias("target_key"),
        F.col("meta.dependency_kind").alias("dependency_kind"),
        F.col("meta.weight").alias("weight"),
        "evidence_class",
        "evidence_id",
    )
    edges = edge_frame(
        facts,
        dataset_id,
        "DEPENDS_ON",
        discriminator=F.col("dependency_kind"),
        canonical_key=_keyed("DEPENDS_ON", F.col("dependency_kind")),
        props=edge_props(dependency_kind=F.col("dependency_kind"), weight=F.col("weight")),
        evidence_class=F.col("evidence_class"),
        keep=("evidence_id",),
        person=person,
    )
    return _split(edges)


def cochange_facts(evidence: DataFrame) -> DataFrame:
    module = lambda side: F.concat(
        F.lit("module:"), F.col(f"meta.{side}_module_external_id")
    )
    return evidence.where(F.col("predicate") == "cochange").select(
        F.least(module("source"), module("target")).alias("source_key"),
        F.greatest(module("source"), module("target")).alias("target_key"),
        F.coalesce("meta.cochange_count", "meta.weight", F.lit(1)).alias("n"),
        "evidence_class",
        "evidence_id",
    )


def depends_cochange(evidence: DataFrame, dataset_id: str, person: bytes = DEFAULT_PERSON) -> Derived:
    """DEPENDS_ON between modules that change together, one edge per unordered pair."""
    facts = cochange_facts(evidence)
    sums = facts.groupBy("source_key", "target_key").agg(F.sum("n").alias("weight"))
    edges = edge_frame(
        sums,
        dataset_id,
        "DEPENDS_ON",
        discriminator=F.lit("cochange"),
        canonical_key=_keyed("DEPENDS_ON", F.lit("cochange")),
        props=edge_props(dependency_kind=F.lit("cochange"), weight=F.col("weight")),
        evidence_class=F.lit("inferred"),
        person=person,
    )
    return edges, _claims(facts, dataset_id, "DEPENDS_ON", F.lit("cochange"), person)


def derived_parts(
    evidence: DataFrame,
    edges: DataFrame,
    links: DataFrame,
    dataset_id: str,
    person: bytes = DEFAULT_PERSON,
) -> dict[str, Derived]:
    """Derived edges and their links by relation type."""
    owns = (
        owns_aggregate(evidence, dataset_id, person),
        owns_assertion(evidence, dataset_id, person),
        owns_density(evidence, edges, links, dataset_id, person),
    )
    depends = (depends_explicit(evidence, dataset_id, person), depends_cochange(evidence, dataset_id, person))
    return {
        "COMMUNICATES": communicates(evidence, dataset_id, person),
        "OWNS": (union_all(*[p[0] for p in owns]), union_all(*[p[1] for p in owns])),
        "DEPENDS_ON": (union_all(*[p[0] for p in depends]), union_all(*[p[1] for p in depends])),
    }


def derive_edges(
    evidence: DataFrame,
    edges: DataFrame,
    links: DataFrame,
    dataset_id: str,
    person: bytes = DEFAULT_PERSON,
) -> Derived:
    parts = derived_parts(evidence, edges, links, dataset_id, person).values()
    return union_all(*[p[0] for p in parts]), union_all(*[p[1] for p in parts])
