"""Fixed row shapes: export rows, canonical records, graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabularies of the graph.
NODE_PREFIX = {
    "Person": "person:",
    "Team": "team:",
    "Artifact": "artifact:",
    "Module": "module:",
    "Phantom": "artifact:",
}
REL_TYPES = (
    "REPORTS_TO",
    "AUTHORED",
    "REPLIES_TO",
    "MENTIONS",
    "COMMUNICATES",
    "ABOUT",
    "OWNS",
    "DEPENDS_ON",
    "PRECEDED_BY",
)
EVIDENCE_CLASSES = ("observed", "inferred", "demo_ground_truth")
LABEL_OF_KIND = {
    "directory_person": "Person",
    "directory_team": "Team",
    "team": "Team",
    "artifact": "Artifact",
    "module": "Module",
}

# Known metadata keys in alphabetical order, so that to_json gives canonical JSON.
META = (
    "artifact_kind STRING, attributed_count BIGINT, authority STRING, authority_rank BIGINT, "
    "canonical_key STRING, cochange_count BIGINT, confidence BIGINT, criticality DOUBLE, "
    "dependency_kind STRING, display_name STRING, evidence_class STRING, first_epoch BIGINT, "
    "identity_candidate_id STRING, identity_confidence BIGINT, identity_primary BOOLEAN, "
    "identity_signal STRING, identity_source STRING, identity_status STRING, "
    "interaction_count BIGINT, interaction_kind STRING, language STRING, last_epoch BIGINT, "
    "location STRING, manager_external_id STRING, module_external_id STRING, module_name STRING, "
    "parent_team_id STRING, product STRING, recipient_external_id STRING, "
    "relationship_class STRING, repo STRING, role STRING, role_rank BIGINT, "
    "sender_external_id STRING, sequence_key STRING, sequence_ordinal BIGINT, "
    "source_identity STRING, source_identity_count BIGINT, source_module_external_id STRING, "
    "target_module_external_id STRING, team_key STRING, title STRING, "
    "total_attributed_count BIGINT, valid_from_epoch BIGINT, valid_until_epoch BIGINT, "
    "weight BIGINT"
)
META_TYPES = dict(part.split(" ") for part in META.split(", "))

NODE_PROPS = (
    "artifact_kind STRING, contract_ref STRING, created_epoch BIGINT, criticality DOUBLE, "
    "days_after_corpus_start BIGINT, display_name STRING, expected_kind STRING, ext_ref STRING, "
    "handle STRING, identity_candidate_id STRING, identity_confidence BIGINT, "
    "identity_primary BOOLEAN, identity_signal STRING, identity_source STRING, "
    "identity_status STRING, inferred_epoch BIGINT, kind STRING, language STRING, name STRING, "
    "parent_team_id STRING, reason STRING, repair_applied BOOLEAN, repo STRING, "
    "role_rank BIGINT, source_identity STRING, source_type STRING, team_id STRING, "
    "thread_seq BIGINT, window_position STRING"
)
NODE_PROP_TYPES = dict(part.split(" ") for part in NODE_PROPS.split(", "))

EDGE_PROPS = (
    "attributed_count BIGINT, authority STRING, authority_rank BIGINT, confidence BIGINT, "
    "contract_id STRING, dependency_kind STRING, email_weight BIGINT, first_epoch BIGINT, "
    "interaction_count BIGINT, last_epoch BIGINT, mention_weight BIGINT, observed_epoch BIGINT, "
    "owner_rank BIGINT, reason STRING, repair_applied BOOLEAN, repair_id STRING, "
    "reply_weight BIGINT, sequence_key STRING, source_record_id STRING, "
    "total_attributed_count BIGINT, valid_from_epoch BIGINT, valid_until_epoch BIGINT, "
    "weight BIGINT"
)
EDGE_PROP_TYPES = dict(part.split(" ") for part in EDGE_PROPS.split(", "))

RECORD_COLUMNS = (
    "source",
    "external_id",
    "kind",
    "occurred_at_epoch",
    "author_external_id",
    "parent_external_id",
    "subjects",
    "content_sha256",
    "content",
    "metadata_json",
    "meta",
)
NODE_COLUMNS = (
    "id",
    "canonical_key",
    "path_key",
    "label",
    "evidence_class",
    "confidence",
    "props",
)
EDGE_COLUMNS = (
    "id",
    "canonical_key",
    "source_id",
    "target_id",
    "source_key",
    "target_key",
    "rel_type",
    "evidence_class",
    "confidence",
    "props",
)
EVIDENCE_COLUMNS = (
    "evidence_id",
    "run_id",
    "source_type",
    "source_uri",
    "source_record_id",
    "observed_epoch",
    "subject_key",
    "predicate",
    "object_key",
    "evidence_class",
    "confidence",
    "extraction_method",
    "content_sha256",
    "redacted_excerpt",
    "metadata_json",
)

# A canonical record as it lies in a JSON file. Metadata is kept as text and parsed once.
RECORD_FILE = (
    "source STRING, external_id STRING, kind STRING, occurred_at_epoch BIGINT, "
    "author_external_id STRING, parent_external_id STRING, subjects ARRAY<STRING>, "
    "content_sha256 STRING, content STRING, metadata STRING"
)
CONTRACT_FILE = (
    "contract_id STRING, contract_kind STRING, sequence_key STRING, source_uri STRING, "
    "content_sha256 STRING, limitations ARRAY<STRING>, steps ARRAY<STRUCT<ordinal: INT, "
    "canonical_key: STRING, artifact_kind: STRING, required: BOOLEAN, earliest_epoch: BIGINT, "
    "latest_epoch: BIGINT>>"
)

SLACK_ROW = (
    "id STRING, occurred_at_epoch BIGINT, author_id STRING, thread_parent_id STRING, "
    "parent_author_id STRING, mentions ARRAY<STRING>, module_keys ARRAY<STRING>, text STRING"
)
EMAIL_ROW = (
    "id STRING, occurred_at_epoch BIGINT, from_id STRING, to_ids ARRAY<STRING>, "
    "in_reply_to_id STRING, parent_author_id STRING, subject STRING, body STRING, "
    "module_keys ARRAY<STRING>"
)
TICKET_ROW = (
    "id STRING, occurred_at_epoch BIGINT, reporter_id STRING, title STRING, body STRING, "
    "module_keys ARRAY<STRING>"
)
COMMIT_ROW = (
    "sha STRING, occurred_at_epoch BIGINT, author_id STRING, message STRING, "
    "module_keys ARRAY<STRING>, dependency_keys ARRAY<STRING>"
)


def _struct(types: dict[str, str], values: dict[str, Column]) -> Column:
    unknown = set(values) - set(types)
    if unknown:
        raise ValueError(f"unknown property names: {sorted(unknown)}")
    absent = {data_type: F.lit(None).cast(data_type) for data_type in set(types.values())}
    return F.struct(
        *[
            values[name].cast(data_type).alias(name)
            if name in values
            else absent[data_type].alias(name)
            for name, data_type in types.items()
        ]
    )


def meta_struct(**values: Column) -> Column:
    return _struct(META_TYPES, values)


def node_props(**values: Column) -> Column:
    return _struct(NODE_PROP_TYPES, values)


def edge_props(**values: Column) -> Column:
    return _struct(EDGE_PROP_TYPES, values)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project to a declared row shape; absent columns become nulls."""
    columns = []
    depth, start, parts = 0, 0, []
    for place, char in enumerate(ddl):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(ddl[start:place].strip())
            start = place + 1
    parts.append(ddl[start:].strip())
    for part in parts:
        name, data_type = part.split(" ", 1)
        value = F.col(name) if name in df.columns else F.lit(None)
        columns.append(value.cast(data_type).alias(name))
    return df.select(*columns)
