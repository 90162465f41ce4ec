"""The graph as five tables, and how they are put together from records.

What breaks a rule of the graph never enters it: conflicting statements of a record, node or
edge, edges without an endpoint, facts that cannot be derived from and faulty contracts are set
aside in ``Bundle.quarantine`` with the rule they break. With ``strict`` they raise instead.

Records that state nodes are written once, as are the nodes and their edges. Facts given apart by
kind, and the edges derived from them, are made by what reads them, with the columns it reads.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.functions.ids import DEFAULT_PERSON
from orgweft.functions.text import bare_module
from orgweft.operators import canonicalize as C
from orgweft.operators import identity as I
from orgweft.operators import validate as V
from orgweft.operators.derive import derived_parts
from orgweft.operators.gaps import Gaps, detect_gaps
from orgweft.operators.normalize import (
    code_records,
    email_records,
    slack_records,
    ticket_records,
    union_all,
)
from orgweft.schemas import CONTRACT_FILE, EVIDENCE_COLUMNS, LABEL_OF_KIND, conform
from orgweft.session import few, scalar, stored


@dataclass(frozen=True)
class Bundle:
    """Nodes and edges with their evidence. Provenance is two link tables, not arrays."""

    dataset_id: str
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    node_evidence: DataFrame
    edge_evidence: DataFrame
    limitations: DataFrame
    quarantine: DataFrame | None = None
    link_parts: dict[str, DataFrame] | None = None
    written: bool = True
    # Evidence ids of the links and of rows set aside, if they can be had without the links.
    cited: DataFrame | None = None
    # A frame of edges, and the parts whose union it is: derived edges by type, all others under "".
    edge_parts: tuple[DataFrame, dict[str, DataFrame]] | None = None

    def with_edges(self, edges: DataFrame) -> Bundle:
        return replace(self, edges=edges)

    def with_parts(self, parts: dict[str, DataFrame]) -> Bundle:
        edges = union_all(*parts.values())
        return replace(self, edges=edges, edge_parts=(edges, parts))

    @property
    def parts(self) -> dict[str, DataFrame]:
        """The edges in parts; those of a frame that was put in without parts are one."""
        known = self.edge_parts is not None and self.edge_parts[0] is self.edges
        return self.edge_parts[1] if known else {"": self.edges}

    def with_types(self, edges: dict[str, DataFrame]) -> Bundle:
        """The bundle with its edges of some types replaced."""
        others = {name: rows for name, rows in self.parts.items() if name not in edges}
        others[""] = others[""].where(~F.col("rel_type").isin(*edges))
        return self.with_parts({**others, **edges})

    def of_type(self, *rel_types: str) -> DataFrame:
        """Edges of some types. No other derived edges are in its plan: they would be filtered out,
        but only after every step above them was planned with them.
        """
        own = [self.parts[name] for name in rel_types if name in self.parts]
        return union_all(self.parts[""].where(F.col("rel_type").isin(*rel_types)), *own)

    def links_of(self, *rel_types: str) -> DataFrame:
        """Evidence of edges, of those types at least."""
        if self.link_parts is None:
            return self.edge_evidence
        return union_all(*[self.link_parts[name] for name in rel_types])


def no_contracts(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], CONTRACT_FILE)


OBSERVED = ("REPORTS_TO", "AUTHORED", "ABOUT", "REPLIES_TO")
RECORD = ("source_type", "source_record_id")
# Columns of evidence that hold the payload of its record.
_PAYLOAD = [
    "evidence_id",
    "content_sha256",
    "metadata_json",
    "observed_epoch",
    "predicate",
    "redacted_excerpt",
    "author_external_id",
    "parent_external_id",
    "subjects",
]


@dataclass(frozen=True)
class Stated:
    """Evidence and nodes of records, without their edges."""

    dataset_id: str
    records: V.Split
    facts: list[V.Split]
    candidates: DataFrame
    nodes: V.Split

    @property
    def evidence(self) -> DataFrame:
        return union_all(self.records.kept, *[split.kept for split in self.facts])


def canonicalize(
    records: DataFrame,
    dataset_id: str,
    person: bytes = DEFAULT_PERSON,
    strict: bool = False,
    facts: dict[str, DataFrame] | None = None,
) -> Bundle:
    """Evidence, nodes and observed edges of a set of records. Order-free and idempotent.

    Evidence is written once, split by predicate, so that each derivation reads only the
    facts it is about; nodes and edges are written split by label and type.

    ``facts`` has further records by kind, which state no nodes and answer nothing. No record of
    one frame may have the source and id of a record of another. Their evidence is not written.
    """
    return with_observed_edges(stated_nodes(records, dataset_id, person, strict, facts), person, strict)


def stated_nodes(
    records: DataFrame,
    dataset_id: str,
    person: bytes = DEFAULT_PERSON,
    strict: bool = False,
    facts: dict[str, DataFrame] | None = None,
) -> Stated:
    """The first part of ``canonicalize``, all that gaps need."""
    rows = C.evidence_of(records, dataset_id)
    stated = V.quarantine_statements(
        rows, "evidence", F.concat_ws("/", *RECORD), list(RECORD), _PAYLOAD, C.RECORD_CONFLICT, "predicate", strict
    )
    others = [_unwritten(kind, frame, dataset_id, strict) for kind, frame in (facts or {}).items()]
    candidates = C.node_candidates(stated.kept, dataset_id, person)
    key = "canonical_key"
    nodes = V.quarantine_statements(
        C.node_statements(candidates), "nodes", F.col(key), [key], C.NODE_CONTENT, C.NODE_CONFLICT, "label", strict
    )
    return Stated(dataset_id, stated, others, candidates, nodes)


def with_observed_edges(stated: Stated, person: bytes = DEFAULT_PERSON, strict: bool = False) -> Bundle:
    """The second part of ``canonicalize``: the edges that records state."""
    dataset_id, nodes = stated.dataset_id, stated.nodes
    edge_candidates = C.observed_edge_candidates(stated.records.kept, nodes.kept, dataset_id, person)
    absent = stored(C.absent_endpoints(edge_candidates, nodes.kept), "absent")
    statements = C.with_endpoint_rule(
        edge_candidates.withColumn("rule", F.lit(None).cast("string")), nodes.kept, absent
    )
    key = "canonical_key"
    edges = V.quarantine_statements(
        statements, "edges", F.col(key), [key], C.EDGE_CONTENT, C.EDGE_CONFLICT, "rel_type", strict
    )
    empty = nodes.kept.sparkSession.createDataFrame([], "limitation STRING")
    links = lambda rows: _without(C.edge_links(rows), "edge_key", edges)
    return Bundle(
        dataset_id=dataset_id,
        nodes=nodes.kept,
        edges=edges.kept,
        evidence=stated.evidence,
        node_evidence=_without(C.node_links(stated.candidates), "node_key", nodes),
        edge_evidence=links(edge_candidates),
        limitations=empty,
        quarantine=union_all(
            stated.records.aside, *[split.aside for split in stated.facts], nodes.aside, edges.aside
        ),
        link_parts={name: links(edge_candidates.where(F.col("rel_type") == name)) for name in OBSERVED},
        written=not stated.facts,
        cited=union_all(stated.candidates.select("evidence_id"), edge_candidates.select("evidence_id")),
    )


def _unwritten(kind: str, records: DataFrame, dataset_id: str, strict: bool) -> V.Split:
    """Evidence of one kind of facts. Kind and parent are constants, so that what filters by them
    leaves out the whole kind.
    """
    if kind in LABEL_OF_KIND:
        raise ValueError(f"records of kind {kind} state nodes")
    reduced = C.reduced_records(records, by_field=True).withColumns(
        {"kind": F.lit(kind), "parent_external_id": F.lit(None).cast("string")}
    )
    marked = C.evidence_of(reduced, dataset_id, keep=("rule",))
    split = V.parted(marked, "evidence", F.concat_ws("/", *RECORD))
    if strict:
        V.require_none(split.aside, "evidence")
    return split


def _without(links: DataFrame, key: str, split: V.Split) -> DataFrame:
    """Links without those of rows set aside."""
    if split.count == 0:
        return links
    return links.join(split.aside.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(*links.columns)


def build_bundle(
    records: DataFrame,
    dataset_id: str,
    contracts: DataFrame | None = None,
    person: bytes = DEFAULT_PERSON,
    strict: bool = False,
) -> Bundle:
    return complete(canonicalize(records, dataset_id, person, strict), contracts, person, strict)


@dataclass(frozen=True)
class FoundGaps:
    """The gaps of a graph: its nodes with the phantoms, the edges to these, and what is behind."""

    gaps: Gaps
    nodes: DataFrame
    edges: V.Split
    faulty: DataFrame


def find_gaps(
    evidence: DataFrame,
    nodes: DataFrame,
    contracts: DataFrame | None,
    dataset_id: str,
    person: bytes = DEFAULT_PERSON,
    strict: bool = False,
) -> FoundGaps:
    """Gaps of evidence and nodes; no edge is read for them."""
    given = no_contracts(nodes) if contracts is None else conform(contracts, CONTRACT_FILE)
    faulty = V.contract_violations(given).select(F.lit("contracts").alias("stage"), "key", "rule")
    faulty = stored(faulty, "faulty_contracts")
    wanted = given.join(faulty.select(F.col("key").alias("contract_id")).distinct(), "contract_id", "left_anti").select(
        *given.columns
    )
    if strict:
        V.require_none(faulty, "contracts")
    gaps = detect_gaps(evidence, nodes, wanted, dataset_id, person)
    nodes = nodes.unionByName(stored(gaps.nodes, "phantoms"))
    edges = V.quarantine(_checked(gaps.edges, nodes), "edges", F.col("canonical_key"), "rel_type", strict)
    return FoundGaps(gaps, nodes, edges, faulty)


def complete(
    base: Bundle,
    contracts: DataFrame | None = None,
    person: bytes = DEFAULT_PERSON,
    strict: bool = False,
    found: FoundGaps | None = None,
) -> Bundle:
    """The base graph with its derived edges and gap phantoms.

    Only what is new is written, beside the base graph; derived edges not even that where the base
    has facts that were not. ``found`` has the gaps, if ``find_gaps`` was run before.
    """
    dataset_id = base.dataset_id
    unusable = V.derivation_violations(base.evidence).select(F.lit("derivation").alias("stage"), "key", "rule")
    usable = base.evidence.where(V.derivable())
    derived = derived_parts(usable, base.edges, base.links_of("AUTHORED", "ABOUT"), dataset_id, person)
    if strict:
        V.require_none(unusable, "derivation")
    if found is None:
        found = find_gaps(base.evidence, base.nodes, contracts, dataset_id, person, strict)
    gaps, nodes = found.gaps, found.nodes
    gap_links = _without(gaps.edge_links, "edge_key", found.edges)
    edges = {"": union_all(base.edges, found.edges.kept)}
    asides = [base.quarantine, unusable, found.faulty, found.edges.aside]
    parts = {**(base.link_parts or {}), "PRECEDED_BY": gap_links}
    parts["REPLIES_TO"] = parts["REPLIES_TO"].unionByName(gap_links) if "REPLIES_TO" in parts else gap_links
    near = few(C.near_nodes(nodes))
    for rel_type, (rows, links) in derived.items():
        unchecked = rows.withColumn("rule", F.lit(None).cast("string"))
        checked = C.with_near_endpoint_rule(unchecked, nodes, near, rel_type)
        split = V.parted(checked, "edges", F.col("canonical_key"))
        if base.written:
            split = V.quarantine(checked, "edges", F.col("canonical_key"), None, strict)
        elif strict:
            V.require_none(split.aside, "edges")
        edges[rel_type] = split.kept.withColumn("rel_type", F.lit(rel_type))
        asides.append(split.aside)
        parts[rel_type] = _without(links, "edge_key", split)
    own = [parts[rel_type] for rel_type in derived]
    return replace(
        base.with_parts(edges),
        nodes=nodes,
        evidence=base.evidence.select(*EVIDENCE_COLUMNS).unionByName(stored(gaps.evidence, "gap_evidence")),
        node_evidence=base.node_evidence.unionByName(gaps.node_links),
        edge_evidence=union_all(base.edge_evidence, *own, gap_links),
        limitations=base.limitations.unionByName(gaps.limitations).distinct(),
        quarantine=union_all(*[part for part in asides if part is not None]),
        link_parts=None if base.link_parts is None else parts,
        cited=None,
    )


def _checked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return C.with_endpoint_rule(edges.withColumn("rule", F.lit(None).cast("string")), nodes)


def ingest_records(
    *,
    dataset_id: str,
    directory: DataFrame,
    identity_map: DataFrame | None = None,
    canonical: DataFrame | None = None,
    slack: DataFrame | None = None,
    email: DataFrame | None = None,
    ticket: DataFrame | None = None,
    git: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Export rows of every source to (records, limitation texts).

    Ids that no map knows become visible unresolved people, and modules the records do
    not declare are dropped from the rows; both are reported.
    """
    spark = directory.sparkSession
    if identity_map is None:
        identity_map = spark.createDataFrame([], "source_id STRING, handle STRING")
    handles = directory.where("kind = 'directory_person'").select(F.col("external_id").alias("handle"))
    declared = directory if canonical is None else directory.unionByName(canonical)
    modules = declared.where("kind = 'module'").select(
        F.coalesce(bare_module(F.col("meta.canonical_key")), bare_module(F.col("external_id"))).alias(
            "module"
        )
    )
    lookup = I.handle_lookup(identity_map, handles)
    sources = (
        ("slack", slack, slack_records, "id"),
        ("email", email, email_records, "id"),
        ("ticket", ticket, ticket_records, "id"),
        ("git", git, code_records, "sha"),
    )
    parts, missing, unknown = [declared], [], []
    for kind, rows, to_records, id_column in sources:
        if rows is None:
            continue
        missing.append(I.unresolved_ids(rows, kind, lookup))
        unknown.append(I.unknown_modules(rows, modules))
        resolved = I.resolve_rows(rows, kind, lookup)
        parts.append(to_records(I.drop_unknown_modules(resolved, modules, id_column)))
    if not missing:
        return declared, spark.createDataFrame([], "limitation STRING")
    unresolved = union_all(*missing).distinct()
    epoch = F.coalesce(scalar(directory, F.min("occurred_at_epoch")), F.lit(0))
    parts.append(
        I.unresolved_stubs(unresolved, handles, source=f"{dataset_id}-identity", epoch=epoch)
    )
    notes = union_all(
        I.unresolved_limitation(unresolved), I.module_limitation(union_all(*unknown).distinct())
    )
    return union_all(*parts), notes


def ingest_exports(
    *,
    dataset_id: str,
    contracts: DataFrame | None = None,
    person: bytes = DEFAULT_PERSON,
    **sources: DataFrame | None,
) -> Bundle:
    """Mixed exports to one bundle; keyword sources as in ``ingest_records``."""
    records, notes = ingest_records(dataset_id=dataset_id, **sources)
    bundle = build_bundle(records, dataset_id, contracts, person)
    return replace(bundle, limitations=bundle.limitations.unionByName(notes).distinct())


def ingest_summary(bundle: Bundle) -> DataFrame:
    """(measure, n): nodes, edges, evidence, people, unresolved people, limitations."""
    people = bundle.nodes.where("label = 'Person'")
    measures = [
        ("nodes", bundle.nodes, F.count("*")),
        ("edges", bundle.edges, F.count("*")),
        ("evidence", bundle.evidence, F.count("*")),
        ("people", people, F.count("*")),
        (
            "unresolved_people",
            people,
            F.count_if(F.coalesce("props.identity_status", F.lit("")) == "unresolved"),
        ),
        ("limitations", bundle.limitations, F.count("*")),
    ]
    return union_all(
        *[frame.agg(count.alias("n")).select(F.lit(name).alias("measure"), "n") for name, frame, count in measures]
    )
