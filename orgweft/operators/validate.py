"""Data checks. Each returns the offending rows, so an empty frame means the check passed."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orgweft.functions.ids import path_key
from orgweft.operators.canonicalize import missing_endpoints, reduced
from orgweft.operators.derive import DEPENDENCY_KINDS, INTERACTION_KINDS
from orgweft.operators.normalize import union_all
from orgweft.schemas import EVIDENCE_CLASSES, NODE_PREFIX, REL_TYPES
from orgweft.session import few, stored

SHA256 = "^[0-9a-f]{64}$"


class CheckFailed(ValueError):
    """A required check found offending rows."""


def require_none(violations: DataFrame, what: str) -> None:
    """Raise when a check returned rows; shows a few of them."""
    rows = violations.take(3)
    if rows:
        raise CheckFailed(f"{what}: {[row.asDict() for row in rows]}")


@dataclass(frozen=True)
class Split:
    """Rows that break no rule, and ``stage, key, rule`` of the ``count`` others."""

    kept: DataFrame
    aside: DataFrame
    count: int | None


def quarantine(
    df: DataFrame, stage: str, key: Column, partition_by: str | None = None, strict: bool = False
) -> Split:
    """Write ``df`` once and part the rows whose ``rule`` is set from the others.

    The rows set aside are counted by the write itself. ``strict`` raises if there are any.
    """
    seen = Observation(f"{stage}-{uuid.uuid4().hex}")
    whole = stored(df.observe(seen, F.count("rule").alias("n")), stage, partition_by)
    split = parted(whole, stage, key, seen.get["n"])
    if strict:
        require_none(split.aside.limit(0) if not split.count else split.aside, stage)
    return split


def quarantine_statements(
    df: DataFrame,
    stage: str,
    key: Column,
    keys: list[str],
    content: list[str],
    conflict: str,
    partition_by: str | None = None,
    strict: bool = False,
) -> Split:
    """``quarantine`` of statements: one row per ``keys``, with the rule ``conflict`` where rows of
    the keys differ in their content.

    Statements are written as they come. Hashes of their keys alone are shuffled to find those that
    come twice; only if there are any are these reduced, and the table written again with them.
    """
    if "rule" not in df.columns:
        df = df.withColumn("rule", F.lit(None).cast("string"))
    seen = Observation(f"{stage}-{uuid.uuid4().hex}")
    whole = stored(df.observe(seen, F.count("rule").alias("n")), stage, partition_by)
    repeated = stored(_repeated_marks(whole.select(F.xxhash64(*keys).alias("mark"))), "repeated")
    if not repeated.isEmpty():
        suspect = F.xxhash64(*keys) == F.col("mark")
        again = few(repeated)
        several = reduced(
            whole.join(again, suspect, "left_semi").withColumnRenamed("rule", "own_rule"), keys, content, conflict
        ).withColumn("rule", F.coalesce("rule", "own_rule"))
        single = whole.join(again, suspect, "left_anti")
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        merged = single.unionByName(several.select(*whole.columns))
        whole = stored(merged.observe(seen, F.count("rule").alias("n")), stage, partition_by)
    split = parted(whole, stage, key, seen.get["n"])
    if strict:
        require_none(split.aside.limit(0) if not split.count else split.aside, stage)
    return split


def _repeated_marks(marks: DataFrame) -> DataFrame:
    """Marks that come twice, once each."""
    names = marks.columns
    return marks.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names)


def parted(df: DataFrame, stage: str, key: Column, count: int | None = None) -> Split:
    """Rows whose ``rule`` is set apart from the others, without writing them."""
    names = [name for name in df.columns if name != "rule"]
    aside = df.where("rule IS NOT NULL").select(F.lit(stage).alias("stage"), key.alias("key"), "rule")
    return Split(df.where("rule IS NULL").select(*names), aside, count)


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    )


def _violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for every rule a row breaks."""
    return df.select(key.alias("key"), F.explode(_broken(rules)).alias("rule"))


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.regexp_replace(name, r"\s", "")) == "")


def export_row_violations(
    rows: DataFrame, required: list[str], optional: list[str] = (), lists: list[str] = ()
) -> DataFrame:
    """Missing required text, negative epochs, blank optional text, blank list members."""
    rules = {f"{name} is required": _blank(name) for name in required}
    rules["occurred_at_epoch must be a non-negative integer"] = F.col(
        "occurred_at_epoch"
    ).isNull() | (F.col("occurred_at_epoch") < 0)
    for name in optional:
        rules[f"{name} must not be blank"] = F.col(name).isNotNull() & _blank(name)
    for name in lists:
        rules[f"{name} must hold non-empty strings"] = F.exists(
            F.coalesce(name, F.array().cast("array<string>")),
            lambda x: x.isNull() | (F.trim(x) == ""),
        )
    return _violations(rows, F.col(required[0]), rules)


def record_violations(records: DataFrame) -> DataFrame:
    """Canonical records that break the closed record shape."""
    subjects = F.col("subjects")
    rules = {
        "source is required": _blank("source"),
        "external_id is required": _blank("external_id"),
        "kind is required": _blank("kind"),
        "epoch must be non-negative": F.col("occurred_at_epoch").isNull()
        | (F.col("occurred_at_epoch") < 0),
        "content_sha256 must be 64 hex digits": ~F.coalesce(
            F.col("content_sha256").rlike(SHA256), F.lit(False)
        ),
        "subjects must be non-empty": F.exists(subjects, lambda s: F.trim(s) == ""),
        "subjects must be distinct": F.size(F.array_distinct(subjects)) != F.size(subjects),
        "evidence_class is unknown": F.col("meta.evidence_class").isNotNull()
        & ~F.col("meta.evidence_class").isin(*EVIDENCE_CLASSES),
    }
    return _violations(records, F.concat_ws("/", "source", "external_id"), rules)


def metadata_violations(records: DataFrame) -> DataFrame:
    """Metadata members that are not scalars: nested, null, or a number beyond 64 bits."""
    members = records.select(
        F.concat_ws("/", "source", "external_id").alias("key"),
        F.explode(F.from_json("metadata_json", "map<string, variant>")).alias("name", "value"),
    )
    kind = F.schema_of_variant("value")
    bad = (
        (F.trim("name") == "")
        | kind.startswith("OBJECT")
        | kind.startswith("ARRAY")
        | (kind == "VOID")
        | (kind.startswith("DECIMAL") & ~F.to_json("value").rlike(r"[.eE]"))
    )
    return members.where(bad).select("key", F.concat(F.lit("metadata."), F.col("name")).alias("rule"))


def contract_violations(contracts: DataFrame) -> DataFrame:
    """Contracts with too few, unordered or repeated steps, or an id used twice.

    The rules of one contract are checked inside its row.
    """
    steps = F.col("steps")
    ordinals = F.transform(steps, lambda s: s["ordinal"])
    keys = F.transform(steps, lambda s: s["canonical_key"])
    shifted = F.transform(
        ordinals,
        lambda o, i: (i > 0) & (o <= F.element_at(ordinals, F.greatest(i, F.lit(1)))),
    )
    rules = {
        "at least two steps": F.size(steps) < 2,
        "ordinals must increase": F.exists(shifted, lambda x: x),
        "step keys must be distinct": F.size(F.array_distinct(keys)) != F.size(keys),
        "epoch bounds must be ordered": F.exists(
            steps, lambda s: F.coalesce(s["earliest_epoch"] > s["latest_epoch"], F.lit(False))
        ),
        "content_sha256 must be 64 hex digits": ~F.col("content_sha256").rlike(SHA256),
        "contract_kind is unknown": ~F.col("contract_kind").isin(
            "contiguous_sequence", "required_audit_transition"
        ),
    }
    repeated = (
        contracts.groupBy("contract_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("contract_id").alias("key"), F.lit("contract_id is used twice").alias("rule"))
    )
    return _violations(contracts, F.col("contract_id"), rules).unionByName(repeated)


def _repeated(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``key, rule`` of values that come twice in a column, from (table, column, rule).

    Only hashes of the values are shuffled; the values themselves are counted where a hash comes
    twice.
    """
    value = lambda column: F.col(column).cast("string")
    marks = union_all(
        *[
            df.select(F.lit(place).alias("place"), F.xxhash64(value(column)).alias("mark"))
            for place, (df, column, _rule) in enumerate(tables)
        ]
    )
    again = few(stored(_repeated_marks(marks), "repeated"))
    found = []
    for place, (df, column, rule) in enumerate(tables):
        suspects = df.select(value(column).alias("key")).join(
            again.where(F.col("place") == place), F.xxhash64("key") == F.col("mark"), "left_semi"
        )
        found.append(_repeated_marks(suspects).select("key", F.lit(rule).alias("rule")))
    return union_all(*found)


def _unknown_evidence(bundle) -> DataFrame:
    """``key, rule`` of links to evidence that is not there.

    Cited ids are looked up first, each once and by two hashes; links are read only if one of these
    has no evidence.
    """
    rule = F.lit("evidence is unknown").alias("rule")
    links = bundle.node_evidence.select(F.col("node_key").alias("key"), "evidence_id").unionByName(
        bundle.edge_evidence.select(F.col("edge_key").alias("key"), "evidence_id")
    )
    known = bundle.evidence.select("evidence_id")
    if bundle.cited is not None:
        marks = lambda ids: ids.select(
            F.xxhash64("evidence_id").alias("a"), F.xxhash64(F.lit(1), "evidence_id").alias("b"), F.col("evidence_id").isNull().alias("c")
        )
        lost = marks(bundle.cited).distinct().join(marks(known.where("evidence_id IS NOT NULL")), ["a", "b", "c"], "left_anti")
        if lost.isEmpty():
            return links.select("key", rule).where(F.lit(False))
    return links.join(known, "evidence_id", "left_anti").select("key", rule)


def bundle_violations(bundle) -> DataFrame:
    """``key, rule``: repeated or shared ids, missing endpoints, unknown evidence."""
    nodes, edges = bundle.nodes, bundle.edges
    shared = nodes.select("id").join(edges.select("id"), "id", "left_semi")
    repeated = [
        (nodes, "id", "node id is not unique"),
        (nodes, "canonical_key", "node key is not unique"),
        (nodes, "path_key", "path key is not unique"),
        (edges, "id", "edge id is not unique"),
        (edges, "canonical_key", "edge key is not unique"),
        (bundle.evidence, "evidence_id", "evidence id is not unique"),
    ]
    return union_all(
        _repeated(repeated),
        shared.select(F.col("id").cast("string").alias("key"), F.lit("node and edge share an id").alias("rule")),
        missing_endpoints(edges, nodes).select(
            F.col("edge_key").alias("key"), F.lit("endpoint is missing").alias("rule")
        ),
        _unknown_evidence(bundle),
    ).distinct()


def label_violations(nodes: DataFrame) -> DataFrame:
    """Nodes whose key prefix or path key does not follow from their label and id."""
    prefix = F.create_map(*[F.lit(x) for pair in NODE_PREFIX.items() for x in pair])[F.col("label")]
    rules = {
        "label is unknown": ~F.col("label").isin(*NODE_PREFIX),
        "key does not match the label": ~F.startswith("canonical_key", prefix),
        "path key does not match": F.col("path_key") != path_key(F.col("label"), F.col("id")),
    }
    return _violations(nodes, F.col("canonical_key"), rules)


def edge_violations(edges: DataFrame) -> DataFrame:
    rules = {
        "relation type is unknown": ~F.col("rel_type").isin(*REL_TYPES),
        "confidence must be 0 to 100": ~F.col("confidence").between(0, 100),
        "evidence class is unknown": ~F.col("evidence_class").isin(*EVIDENCE_CLASSES),
    }
    return _violations(edges, F.col("canonical_key"), rules)


def id_collisions(identities: DataFrame) -> DataFrame:
    """From ``id, identity``: ids of several identities, identities with several ids."""
    collided = (
        identities.groupBy(F.col("id").cast("string").alias("key"))
        .agg(F.min("identity").alias("a"), F.max("identity").alias("b"))
        .where("a <> b")
        .select("key", F.lit("one id, two identities").alias("rule"))
    )
    drifted = (
        identities.groupBy(F.col("identity").alias("key"))
        .agg(F.min("id").alias("a"), F.max("id").alias("b"))
        .where("a <> b")
        .select("key", F.lit("one identity, two ids").alias("rule"))
    )
    return collided.unionByName(drifted)


def _derivation_rules() -> dict[str, Column]:
    meta = lambda name: F.col(f"meta.{name}")
    on = lambda predicate, bad: (F.col("predicate") == predicate) & bad
    attributed, total = meta("attributed_count"), meta("total_attributed_count")
    weight = F.coalesce(meta("cochange_count"), meta("weight"), F.lit(1))
    return {
        "interaction kind is unknown": on(
            "communication_aggregate",
            meta("interaction_kind").isNull() | ~meta("interaction_kind").isin(*INTERACTION_KINDS),
        ),
        "interaction counts must be integers": on(
            "communication_aggregate",
            meta("interaction_count").isNull()
            | meta("first_epoch").isNull()
            | meta("last_epoch").isNull(),
        ),
        "authorship counts are out of range": on(
            "authorship_aggregate",
            attributed.isNull() | total.isNull() | (total <= 0) | (attributed < 0) | (attributed > total),
        ),
        "dependency kind is unknown": on(
            "dependency",
            meta("dependency_kind").isNull() | ~meta("dependency_kind").isin(*DEPENDENCY_KINDS),
        ),
        "assertion fields are missing": on(
            "ownership_assertion",
            meta("confidence").isNull()
            | meta("authority_rank").isNull()
            | meta("authority").isNull()
            | meta("valid_from_epoch").isNull(),
        ),
        "cochange weight must be positive": on("cochange", weight <= 0),
        "cochange of one module": on(
            "cochange", meta("source_module_external_id") == meta("target_module_external_id")
        ),
    }


def derivation_violations(evidence: DataFrame) -> DataFrame:
    """Facts the derivation cannot use: unknown kinds, counts out of range, self co-change."""
    return _violations(evidence, F.concat_ws("/", "source_type", "source_record_id"), _derivation_rules())


def derivable() -> Column:
    """Whether the derivation can use an evidence row."""
    return F.size(_broken(_derivation_rules())) == 0
