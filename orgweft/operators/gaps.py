"""Structural gaps: thread parents and required steps that are not in the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orgweft.functions.ids import DEFAULT_PERSON, path_key, stable_id
from orgweft.functions.text import json_array, json_object, json_text, key_suffix
from orgweft.operators.canonicalize import edge_frame, label_of_key, parent_key
from orgweft.operators.normalize import union_all
from orgweft.schemas import EVIDENCE_COLUMNS, NODE_COLUMNS, edge_props, node_props
from orgweft.session import scalar

EXPORT_BOUNDARY_DAYS = 30
DANGLING_NOTE = (
    "A dangling thread parent is structurally absent; absence does not establish deletion."
)


@dataclass(frozen=True)
class Gaps:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    node_links: DataFrame
    edge_links: DataFrame
    limitations: DataFrame


def corpus_start(nodes: DataFrame) -> Column:
    """Earliest artifact epoch, as a scalar subquery."""
    artifacts = nodes.where("label = 'Artifact'")
    return scalar(artifacts, F.min("props.created_epoch"))


def days_after(epoch: Column, start: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((epoch - start) / 86400)).cast("bigint")


def window_position(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit("unknown"))
        .when(days <= EXPORT_BOUNDARY_DAYS, F.lit("export_boundary"))
        .otherwise(F.lit("in_window"))
    )


def dangling_parents(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence of an artifact whose thread parent is not a node."""
    claims = evidence.where(F.length(F.trim("parent_external_id")) > 0).select(
        F.col("subject_key").alias("child_key"),
        parent_key().alias("parent_key"),
        "evidence_id",
        "observed_epoch",
        "content_sha256",
    )
    artifacts = nodes.where("label = 'Artifact'").select(F.col("canonical_key").alias("child_key"))
    known = nodes.select(F.col("canonical_key").alias("parent_key"))
    return claims.join(artifacts, "child_key", "left_semi").join(known, "parent_key", "left_anti")


def _gap_evidence(values: dict[str, Column], dataset_id: str) -> list[Column]:
    fixed = {
        "run_id": F.lit(f"gaps:{dataset_id}"),
        "predicate": F.lit("gap_phantom"),
        "evidence_class": F.lit("inferred"),
        "confidence": F.lit(100),
        "redacted_excerpt": F.lit(""),
    }
    return [({**fixed, **values})[name].alias(name) for name in EVIDENCE_COLUMNS]


def dangling_phantoms(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """One phantom per absent parent; the claim with the greatest evidence id describes it."""
    start = corpus_start(nodes)
    picked = claims.groupBy("parent_key").agg(
        F.max_by(F.struct("child_key", "observed_epoch", "evidence_id"), "evidence_id").alias("c")
    )
    days = days_after(F.col("c.observed_epoch"), start)
    return picked.select(
        F.col("parent_key").alias("canonical_key"),
        F.col("c.child_key").alias("child_key"),
        F.col("c.evidence_id").alias("source_evidence_id"),
        F.col("c.observed_epoch").alias("inferred_epoch"),
        days.alias("days_after_corpus_start"),
        window_position(days).alias("window_position"),
    )


def _dangling_digest(dataset_id: str) -> Column:
    return F.sha2(
        json_object(
            child_key=json_text(F.col("child_key")),
            dataset_id=json_text(F.lit(dataset_id)),
            parent_key=json_text(F.col("parent_key")),
            source_evidence_id=json_text(F.col("source_evidence_id")),
        ),
        256,
    )


def contract_steps(contracts: DataFrame) -> DataFrame:
    """One row per step with its place in the contract."""
    return contracts.select(
        "contract_id",
        "sequence_key",
        "source_uri",
        "content_sha256",
        F.posexplode("steps").alias("place", "step"),
    ).select("contract_id", "sequence_key", "source_uri", "content_sha256", "place", "step.*")


def step_status(contracts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps kept in the chain: present ones, and required ones that are absent."""
    present = nodes.select(F.col("canonical_key"), F.lit(True).alias("present"))
    steps = contract_steps(contracts).withColumn(
        "required", F.coalesce("required", F.lit(True))
    )
    joined = steps.join(present, "canonical_key", "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )
    return joined.where("present OR required")


def _step_digest(dataset_id: str) -> Column:
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    step = json_object(
        artifact_kind=json_text(F.col("artifact_kind")),
        canonical_key=json_text(F.col("canonical_key")),
        earliest_epoch=number("earliest_epoch"),
        latest_epoch=number("latest_epoch"),
        ordinal=number("ordinal"),
        required=F.col("required").cast("string"),
    )
    return F.sha2(
        json_object(
            contract_id=json_text(F.col("contract_id")),
            dataset_id=json_text(F.lit(dataset_id)),
            missing_step=step,
            sequence_key=json_text(F.col("sequence_key")),
        ),
        256,
    )


def preceded_by_facts(status: DataFrame) -> DataFrame:
    """Each kept step to the kept step before it, for contracts with a phantom.

    A contract is one input row, so its steps are as few as the row holds.
    """
    order = W.partitionBy("contract_id").orderBy("place")
    chain = status.withColumn("previous", F.lag(F.struct("canonical_key", "present")).over(order))
    broken = (
        status.where("NOT present")
        .groupBy("contract_id")
        .agg(F.min_by("gap_digest", "place").alias("first_digest"))
        if "gap_digest" in status.columns
        else status.where("NOT present").select("contract_id").distinct()
    )
    return chain.where("previous IS NOT NULL").join(broken, "contract_id")


def detect_gaps(
    evidence: DataFrame,
    nodes: DataFrame,
    contracts: DataFrame,
    dataset_id: str,
    person: bytes = DEFAULT_PERSON,
) -> Gaps:
    # Dangling thread parents: one evidence row and one edge per child.
    claims = dangling_parents(evidence, nodes)
    children = claims.withColumnRenamed("evidence_id", "source_evidence_id").withColumn(
        "digest", _dangling_digest(dataset_id)
    )
    thread_evidence = children.select(
        *_gap_evidence(
            {
                "evidence_id": F.concat(F.lit("evidence:"), F.col("digest")),
                "source_type": F.lit("thread_lineage"),
                "source_uri": F.concat(
                    F.lit(f"derived://{dataset_id}/dangling-thread-parent/"), F.col("digest")
                ),
                "source_record_id": F.col("digest"),
                "observed_epoch": F.col("observed_epoch"),
                "subject_key": F.col("parent_key"),
                "object_key": F.col("child_key"),
                "extraction_method": F.lit("dangling_thread_parent_detection"),
                "content_sha256": F.col("content_sha256"),
                "metadata_json": json_object(
                    metadata=json_object(
                        expected_kind=json_text(F.lit("thread_parent")),
                        reason=json_text(F.lit("dangling_thread_parent")),
                        source_evidence_id=json_text(F.col("source_evidence_id")),
                    )
                ),
            },
            dataset_id,
        )
    )
    reply_facts = children.select(
        F.col("child_key").alias("source_key"),
        F.col("parent_key").alias("target_key"),
        "observed_epoch",
        F.concat(F.lit("evidence:"), F.col("digest")).alias("evidence_id"),
    )
    replies = edge_frame(
        reply_facts,
        dataset_id,
        "REPLIES_TO",
        discriminator=F.concat_ws(
            ":", F.lit("dangling_thread_parent"), F.col("source_key"), F.col("target_key")
        ),
        canonical_key=F.concat_ws(
            ":", F.lit("replies_to"), key_suffix(F.col("source_key")), key_suffix(F.col("target_key"))
        ),
        props=edge_props(
            observed_epoch=F.col("observed_epoch"), reason=F.lit("dangling_thread_parent")
        ),
        evidence_class=F.lit("inferred"),
        target_label=F.lit("Phantom"),
        keep=("evidence_id",),
        person=person,
    )
    thread_phantoms = dangling_phantoms(claims, nodes).withColumn(
        "parent_key", F.col("canonical_key")
    )
    thread_nodes = thread_phantoms.select(
        "canonical_key",
        node_props(
            expected_kind=F.lit("thread_parent"),
            reason=F.lit("dangling_thread_parent"),
            inferred_epoch=F.col("inferred_epoch"),
            window_position=F.col("window_position"),
            days_after_corpus_start=F.col("days_after_corpus_start"),
        ).alias("props"),
        F.concat(F.lit("evidence:"), _dangling_digest(dataset_id)).alias("evidence_id"),
        F.lit(0).alias("priority"),
        F.lit("").alias("tie"),
    )

    # Contract steps: one evidence row per absent required step.
    status = step_status(contracts, nodes).withColumn("gap_digest", _step_digest(dataset_id))
    missing = status.where("NOT present")
    step_evidence = missing.select(
        *_gap_evidence(
            {
                "evidence_id": F.concat(F.lit("evidence:"), F.col("gap_digest")),
                "source_type": F.lit("sequence_contract"),
                "source_uri": F.col("source_uri"),
                "source_record_id": F.col("contract_id"),
                "observed_epoch": F.coalesce("earliest_epoch", F.lit(0)),
                "subject_key": F.col("canonical_key"),
                "object_key": F.col("sequence_key"),
                "extraction_method": F.lit("sequence_contract_gap_detection"),
                "content_sha256": F.col("content_sha256"),
                "metadata_json": json_object(
                    metadata=json_object(
                        artifact_kind=json_text(F.col("artifact_kind")),
                        contract_id=json_text(F.col("contract_id")),
                        ordinal=F.col("ordinal").cast("string"),
                        required=F.col("required").cast("string"),
                        sequence_key=json_text(F.col("sequence_key")),
                    )
                ),
            },
            dataset_id,
        )
    )
    step_nodes = missing.select(
        "canonical_key",
        node_props(
            contract_ref=F.col("contract_id"),
            expected_kind=F.col("artifact_kind"),
            reason=F.lit("required_sequence_step_missing"),
            inferred_epoch=F.col("earliest_epoch"),
        ).alias("props"),
        F.concat(F.lit("evidence:"), F.col("gap_digest")).alias("evidence_id"),
        F.lit(1).alias("priority"),
        F.col("contract_id").alias("tie"),
    )
    chosen = (
        union_all(thread_nodes, step_nodes)
        .groupBy("canonical_key")
        .agg(F.max_by(F.struct("props", "evidence_id"), F.struct("priority", "tie")).alias("n"))
        .select("canonical_key", "n.props", "n.evidence_id")
        .withColumn("id", stable_id(dataset_id, "Phantom", F.col("canonical_key"), person=person))
    )
    phantoms = chosen.select(
        "id",
        "canonical_key",
        path_key("Phantom", F.col("id")).alias("path_key"),
        F.lit("Phantom").alias("label"),
        F.lit("inferred").alias("evidence_class"),
        F.lit(100).alias("confidence"),
        "props",
    ).select(*NODE_COLUMNS)

    chain = preceded_by_facts(status).select(
        F.col("canonical_key").alias("source_key"),
        F.col("previous.canonical_key").alias("target_key"),
        F.col("present").alias("source_present"),
        F.col("previous.present").alias("target_present"),
        "contract_id",
        "sequence_key",
        F.concat(F.lit("evidence:"), F.col("first_digest")).alias("evidence_id"),
    )
    label = lambda side: F.when(
        F.col(f"{side}_present"), label_of_key(F.col(f"{side}_key"))
    ).otherwise(F.lit("Phantom"))
    preceded = edge_frame(
        chain,
        dataset_id,
        "PRECEDED_BY",
        discriminator=F.concat_ws(":", "contract_id", "source_key", "target_key"),
        canonical_key=F.concat_ws(
            ":",
            F.lit("preceded_by"),
            key_suffix(F.col("source_key")),
            key_suffix(F.col("target_key")),
            key_suffix(F.col("contract_id")),
        ),
        props=edge_props(contract_id=F.col("contract_id"), sequence_key=F.col("sequence_key")),
        evidence_class=F.lit("inferred"),
        source_label=label("source"),
        target_label=label("target"),
        keep=("evidence_id",),
        person=person,
    )
    all_edges = union_all(replies, preceded)
    notes = union_all(
        claims.limit(1).select(F.lit(DANGLING_NOTE).alias("limitation")),
        contracts.select(F.explode("limitations").alias("limitation")),
    ).distinct()
    return Gaps(
        nodes=phantoms,
        edges=all_edges.drop("evidence_id"),
        evidence=union_all(thread_evidence, step_evidence),
        node_links=chosen.select(
            F.col("id").alias("node_id"), F.col("canonical_key").alias("node_key"), "evidence_id"
        ),
        edge_links=all_edges.select(
            F.col("id").alias("edge_id"), F.col("canonical_key").alias("edge_key"), "evidence_id"
        ),
        limitations=notes,
    )
