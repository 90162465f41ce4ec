"""The lenses: people on many paths, dependencies without coordination, missing records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.functions.ranking import global_row_number, top_per_group
from orgweft.functions.text import capitalize, half_even
from orgweft.operators import graph as G
from orgweft.operators.canonicalize import ARTIFACT, near_nodes
from orgweft.operators.normalize import union_all
from orgweft.session import durable, few, scalar

# Fixed values of the lens rules.
WEAK_DISTANCE = 3
TIER_RISK = {"no_path": 1.0, "weak_coordination": 0.5, "coordinated": 0.0}
IMPACT_PEOPLE = 10
EVIDENCE_SHOWN = 4
MIN_NODE_SIZE, MAX_NODE_SIZE = 20, 82
ROLE_TITLES = {
    0: "member",
    1: "engineer",
    2: "senior engineer",
    3: "lead",
    4: "manager",
    5: "director",
}


def lens_name() -> Column:
    """Display name, else handle, else the key."""
    return F.coalesce(
        F.nullif(F.col("props.display_name"), F.lit("")),
        F.nullif(F.col("props.handle"), F.lit("")),
        F.col("canonical_key"),
    )


# --- communication ----------------------------------------------------------


def communication_window(edges: DataFrame, days: int) -> DataFrame:
    """COMMUNICATES of the last ``days`` days before the latest one; other edges stay.

    Without any communication time nothing is filtered.
    """
    if days <= 0:
        return edges
    talk = edges.where("rel_type = 'COMMUNICATES'")
    latest = scalar(talk, F.max("props.last_epoch"))
    recent = F.col("props.last_epoch") >= latest - F.lit(days * 86400)
    return edges.where(
        (F.col("rel_type") != "COMMUNICATES") | latest.isNull() | F.coalesce(recent, F.lit(False))
    )


def window_note(edges: DataFrame, days: int) -> DataFrame:
    talk = edges.where("rel_type = 'COMMUNICATES'").agg(F.max("props.last_epoch").alias("t"))
    return talk.select(
        F.when(
            F.col("t").isNull(),
            F.lit(
                f"The {days}-day communication window was not applied because no communication "
                "timestamps are available."
            ),
        )
        .otherwise(
            F.concat(
                F.lit(
                    f"Communication edges are filtered to the last {days} days ending at the "
                    "latest observed communication ("
                ),
                F.col("t").cast("string"),
                F.lit(")."),
            )
        )
        .alias("limitation")
    )


def asymmetries(
    nodes: DataFrame, edges: DataFrame, *, min_replies: int = 3, min_ratio: float = 3.0
) -> DataFrame:
    """People whose replies go mostly one way."""
    if min_replies <= 0 or min_ratio <= 1:
        raise ValueError("min_replies must be positive and min_ratio must exceed 1")
    replies = edges.where(
        (F.col("rel_type") == "COMMUNICATES") & (F.col("props.reply_weight") > 0)
    )
    weight = F.col("props.reply_weight")
    flows = replies.select(
        F.explode(
            F.array(
                F.struct(F.col("source_key").alias("person_key"), weight.alias("sent"), F.lit(0).cast("bigint").alias("received")),
                F.struct(F.col("target_key").alias("person_key"), F.lit(0).cast("bigint").alias("sent"), weight.alias("received")),
            )
        ).alias("f")
    ).select("f.*")
    sums = flows.groupBy("person_key").agg(
        F.sum("sent").alias("replies_sent"), F.sum("received").alias("replies_received")
    )
    high = F.greatest("replies_sent", "replies_received")
    low = F.least("replies_sent", "replies_received")
    rated = sums.withColumn("imbalance_ratio", high / F.greatest(F.lit(1), low)).where(
        (high >= min_replies) & (F.col("imbalance_ratio") >= min_ratio)
    )
    names = nodes.select(F.col("canonical_key").alias("person_key"), lens_name().alias("display_name"))
    return rated.join(names, "person_key").select(
        "person_key",
        "display_name",
        "replies_sent",
        "replies_received",
        "imbalance_ratio",
        F.when(F.col("replies_sent") > F.col("replies_received"), F.lit("mostly_sends"))
        .otherwise(F.lit("mostly_receives"))
        .alias("direction"),
    )


# --- people on many paths ---------------------------------------------------


def ghost_scores(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    max_len: int = 4,
    graph: G.Graph | None = None,
    method: str = "exact",
) -> DataFrame:
    """Structural rank by betweenness against formal rank by role, per resolved person.

    ``method`` is the caller's: "exact" is quadratic in the people, "bounded" counts paths of at
    most ``max_len`` hops. The number of people never changes it.
    """
    if method not in ("exact", "bounded"):
        raise ValueError("method must be exact or bounded")
    people = G.resolved_people(nodes).select(
        F.col("canonical_key").alias("person_key"),
        lens_name().alias("display_name"),
        F.coalesce("props.role_rank", F.lit(0)).alias("role_rank"),
    )
    walked = graph or G.communication_graph(nodes, edges)
    if method == "exact":
        centrality = G.betweenness_exact(walked)
        label = "exact_undirected"
    else:
        sources = people.select(F.lit("").alias("g"), F.col("person_key").alias("s"))
        centrality = G.betweenness_bounded(walked, sources, max_len)
        label = f"bounded_undirected_brandes_max_len_{max_len}"
    return rank_people(people, centrality, degrees(edges), label)


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct communication partners per person, unresolved ones included."""
    talk = edges.where("rel_type = 'COMMUNICATES'").select("source_key", "target_key")
    both = talk.union(talk.select("target_key", "source_key")).distinct()
    return both.groupBy(F.col("source_key").alias("person_key")).agg(
        F.count("*").alias("communication_degree")
    )


def rank_people(
    people: DataFrame, centrality: DataFrame, degree: DataFrame, method: str
) -> DataFrame:
    """Both ranks and their gap. Equal centralities within 1e-12 rank by key."""
    scored = (
        people.join(centrality.withColumnRenamed("v", "person_key"), "person_key", "left")
        .join(degree, "person_key", "left")
        .select(
            "person_key",
            "display_name",
            "role_rank",
            F.round(F.coalesce("centrality", F.lit(0.0)), 12).alias("sampled_centrality"),
            F.coalesce("communication_degree", F.lit(0)).alias("communication_degree"),
        )
    )
    structural = global_row_number(
        scored, [F.desc("sampled_centrality"), F.asc("person_key")], "structural_rank"
    )
    both = global_row_number(structural, [F.desc("role_rank"), F.asc("person_key")], "formal_rank")
    return durable(
        both.select(
            "person_key",
            "display_name",
            F.col("role_rank").cast("bigint").alias("role_rank"),
            F.col("structural_rank").cast("bigint").alias("structural_rank"),
            F.col("formal_rank").cast("bigint").alias("formal_rank"),
            (F.col("formal_rank") - F.col("structural_rank")).cast("bigint").alias("rank_gap"),
            "sampled_centrality",
            "communication_degree",
            F.lit(method).alias("centrality_method"),
        )
    )


def removal_impact(graph: G.Graph, people: DataFrame, max_len: int = 4) -> DataFrame:
    """Per person (``person_key``): pairs reached now, pairs lost when they are taken out.

    Their own pairs count as lost.
    """
    before = G.reachable_pairs(graph, max_len).select("pairs").scalar()
    after = G.reachable_pairs(graph, max_len, people.select(F.col("person_key").alias("g")))
    return after.select(
        F.col("g").alias("person_key"),
        before.alias("reachable_pairs_before"),
        (before - F.col("pairs")).alias("pairs_lost_without_person"),
        F.lit(max_len).alias("max_len"),
    )


def bus_factor(graph: G.Graph, person_key: str, max_len: int = 4) -> DataFrame:
    """Pairs among the others before and after the person is taken out."""
    if graph.vertices.where(F.col("v") == person_key).isEmpty():
        raise ValueError(f"unknown person_key {person_key!r}")
    others = graph.vertices.where(F.col("v") != person_key)
    one = graph.vertices.where(F.col("v") == person_key).select(F.col("v").alias("g"))
    before = G.reachable_pairs(graph, max_len, endpoints=others).select("pairs").scalar()
    after = G.reachable_pairs(graph, max_len, one)
    return after.select(
        F.lit(person_key).alias("person_key"),
        before.alias("reachable_pairs_before"),
        (before - F.col("pairs")).alias("pairs_lost_without_person"),
        F.lit(max_len).alias("max_len"),
    )


def ghost_findings(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    max_len: int = 4,
    method: str = "exact",
    impact_people: int = IMPACT_PEOPLE,
) -> DataFrame:
    """Scores of all people; the first ``impact_people`` with the effect of taking them out."""
    graph = G.communication_graph(nodes, edges)
    scores = ghost_scores(nodes, edges, max_len=max_len, graph=graph, method=method)
    impact = removal_impact(graph, scores.where(F.col("structural_rank") <= impact_people), max_len)
    return scores.join(impact.drop("max_len"), "person_key", "left")


def without_people(bundle, people: DataFrame):
    """The bundle without the people (``person_key``) and their edges."""
    gone = people.select("person_key").distinct()
    key = lambda name: gone.withColumnRenamed("person_key", name)
    return replace(
        bundle,
        nodes=bundle.nodes.join(key("canonical_key"), "canonical_key", "left_anti").select(
            *bundle.nodes.columns
        ),
        edges=bundle.edges.join(key("source_key"), "source_key", "left_anti")
        .join(key("target_key"), "target_key", "left_anti")
        .select(*bundle.edges.columns),
    )


def unknown_people(nodes: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ``person_key`` values that name no resolved person."""
    known = G.resolved_people(nodes).select(F.col("canonical_key").alias("person_key"))
    return requested.join(known, "person_key", "left_anti")


def what_if(bundle, people: DataFrame, max_len: int = 4) -> DataFrame:
    """Pairs among the remaining people before and after taking ``people`` out."""
    graph = G.communication_graph(bundle.nodes, bundle.edges)
    gone = people.select(F.col("person_key").alias("v"))
    rest = graph.vertices.join(gone, "v", "left_anti")
    before = G.reachable_pairs(graph, max_len, endpoints=rest)
    reduced = without_people(bundle, people)
    after = G.reachable_pairs(G.communication_graph(reduced.nodes, reduced.edges), max_len)
    return before.select(F.col("pairs").alias("pairs_before"), "g").join(
        after.select(F.col("pairs").alias("pairs_after"), "g"), "g"
    ).select(
        "pairs_before",
        "pairs_after",
        (F.col("pairs_before") - F.col("pairs_after")).alias("pairs_lost"),
        F.lit(max_len).alias("max_len"),
    )


def sampled_ghosts(
    nodes: DataFrame,
    edges: DataFrame,
    order: list[Column],
    *,
    sample: int = 150,
    max_len: int = 4,
    path_count: int = 3,
) -> DataFrame:
    """Scores on the graph of shortest paths between evenly spaced people.

    The pairs are those of the sample, whose size is a parameter, not of the people.
    """
    people = G.resolved_people(nodes)
    graph = G.communication_graph(nodes, edges)
    chosen = durable(G.even_sample(people, order, sample).select("canonical_key"))
    # The sample's size is a fixed parameter, so its keys fit in one array.
    others = chosen.select(F.collect_set("canonical_key")).scalar()
    pairs = (
        chosen.withColumn("others", others)
        .select(F.col("canonical_key").alias("a"), F.explode("others").alias("b"))
        .where("a < b")
    )
    paths = G.all_shortest_paths(graph, pairs, max_len)
    arcs, seen = G.graph_of_paths(paths, path_count)
    known = people.select(F.col("canonical_key").alias("v"))
    kept = arcs.join(known.withColumnRenamed("v", "src"), "src", "left_semi").join(
        known.withColumnRenamed("v", "dst"), "dst", "left_semi"
    )
    induced = G.build_graph(kept, seen.join(known, "v", "left_semi"))
    both = arcs.select("src", "dst").union(arcs.select("dst", "src")).distinct()
    degree = both.groupBy(F.col("src").alias("person_key")).agg(
        F.count("*").alias("communication_degree")
    )
    scored = people.select(
        F.col("canonical_key").alias("person_key"),
        lens_name().alias("display_name"),
        F.coalesce("props.role_rank", F.lit(0)).alias("role_rank"),
    ).join(induced.vertices.select(F.col("v").alias("person_key")), "person_key", "left_semi")
    return rank_people(scored, G.betweenness_exact(induced), degree, "sampled_paths")


# --- dependencies without coordination --------------------------------------


def snapshot_epoch(evidence: DataFrame) -> Column:
    """Latest observation of any evidence (0 without evidence), as a scalar subquery."""
    return F.coalesce(scalar(evidence, F.max("observed_epoch")), F.lit(0))


def owns_facts(edges: DataFrame) -> DataFrame:
    """OWNS with the properties the owner rules read."""
    return edges.where("rel_type = 'OWNS'").select(
        "id",
        "canonical_key",
        F.col("source_key").alias("owner_key"),
        F.col("target_key").alias("module_key"),
        F.coalesce("props.authority_rank", F.lit(0)).alias("authority_rank"),
        F.coalesce("props.authority", F.lit("inferred_authorship")).alias("authority"),
        F.col("props.observed_epoch").alias("observed_epoch"),
        F.coalesce("props.confidence", "confidence").alias("confidence"),
        F.coalesce("props.owner_rank", F.lit(1)).alias("owner_rank"),
        F.col("props.valid_from_epoch").alias("valid_from_epoch"),
        F.col("props.valid_until_epoch").alias("valid_until_epoch"),
    )


def is_valid_at(epoch: Column) -> Column:
    return epoch.between(
        F.coalesce("valid_from_epoch", F.lit(0)), F.coalesce(F.col("valid_until_epoch"), epoch)
    )


def owner_order() -> Column:
    """Sort key: authority, then observation time, then confidence, then key."""
    return F.struct(
        (-F.col("authority_rank")).alias("a"),
        (-F.coalesce("observed_epoch", F.lit(0))).alias("o"),
        (-F.col("confidence")).alias("c"),
        F.col("canonical_key").alias("k"),
    )


def effective_owners(
    edges: DataFrame, evidence: DataFrame, *, min_owner_confidence: int = 50
) -> DataFrame:
    """``module_key, owner_key, confidence``.

    A module with a valid assertion has its best asserted owner; any other module has
    its rank-1 owners and those above the confidence threshold.
    """
    if not 0 <= min_owner_confidence <= 100:
        raise ValueError("min_owner_confidence must be between 0 and 100")
    owns = owns_facts(edges)
    now = snapshot_epoch(evidence)
    fields = ("owner_key", "confidence", "owner_rank")
    asserted = (
        owns.where((F.col("authority_rank") > 0) & is_valid_at(now))
        .groupBy("module_key")
        .agg(F.min_by(F.struct(*fields), owner_order()).alias("best"))
        .select("module_key", *[f"best.{name}" for name in fields])
    )
    inferred = owns.join(asserted.select("module_key"), "module_key", "left_anti").select(
        "module_key", *fields
    )
    return (
        union_all(asserted, inferred)
        .where((F.col("confidence") > min_owner_confidence) | (F.col("owner_rank") == 1))
        .drop("owner_rank")
    )


def with_tier(df: DataFrame) -> DataFrame:
    """Tier and risk of ``communication_distance``."""
    distance = F.col("communication_distance")
    tier = (
        F.when(distance.isNull(), F.lit("no_path"))
        .when(distance >= WEAK_DISTANCE, F.lit("weak_coordination"))
        .otherwise(F.lit("coordinated"))
    )
    risk = F.when(distance.isNull(), F.lit(TIER_RISK["no_path"])).when(
        distance >= WEAK_DISTANCE, F.lit(TIER_RISK["weak_coordination"])
    )
    return df.withColumn("tier", tier).withColumn(
        "severity",
        F.col("dependency_weight")
        * risk.otherwise(F.lit(TIER_RISK["coordinated"])),
    )


def owner_pairs(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Every dependency with each owner of either side."""
    depends = edges.where("rel_type = 'DEPENDS_ON'").select(
        F.col("canonical_key").alias("dependency_key"),
        F.col("source_key").alias("source_module_key"),
        F.col("target_key").alias("target_module_key"),
        F.coalesce("props.weight", F.lit(1)).alias("dependency_weight"),
    )
    side = lambda name: owners.select(
        F.col("module_key").alias(f"{name}_module_key"),
        F.col("owner_key").alias(f"{name}_owner_key"),
        F.col("confidence").alias(f"{name}_owner_confidence"),
    )
    return depends.join(side("source"), "source_module_key").join(
        side("target"), "target_module_key"
    )


def faultlines(
    nodes: DataFrame,
    edges: DataFrame,
    evidence: DataFrame,
    *,
    max_len: int = 4,
    min_owner_confidence: int = 50,
    graph: G.Graph | None = None,
) -> DataFrame:
    """Dependencies whose owners have no short communication path, with a severity."""
    owners = effective_owners(edges, evidence, min_owner_confidence=min_owner_confidence)
    pairs = durable(owner_pairs(edges, owners))
    walked = graph or G.communication_graph(nodes, edges)
    distances = G.pair_distances(
        walked,
        pairs.select(F.col("source_owner_key").alias("a"), F.col("target_owner_key").alias("b")),
        max_len,
    )
    return retier(pairs, distances)


def retier(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """Findings from owner pairs and ``a, b, distance``; coordinated pairs fall out."""
    joined = (
        pairs.drop("communication_distance", "tier", "severity")
        .withColumn("a", F.least("source_owner_key", "target_owner_key"))
        .withColumn("b", F.greatest("source_owner_key", "target_owner_key"))
        .join(distances.withColumnRenamed("distance", "communication_distance"), ["a", "b"], "left")
    )
    return (
        with_tier(joined)
        .where("tier <> 'coordinated' AND severity <> 0")
        .select(
            "dependency_key",
            "source_module_key",
            "target_module_key",
            "source_owner_key",
            "target_owner_key",
            "dependency_weight",
            "source_owner_confidence",
            "target_owner_confidence",
            "communication_distance",
            "tier",
            "severity",
        )
    )


FAULTLINE_ORDER = (
    "-severity",
    "source_module_key",
    "target_module_key",
    "dependency_key",
    "source_owner_key",
    "target_owner_key",
)


def faultline_order() -> list[Column]:
    return [F.desc("severity"), *[F.asc(name) for name in FAULTLINE_ORDER[1:]]]


def naive_faultlines(nodes: DataFrame, edges: DataFrame, max_len: int = 4) -> DataFrame:
    """Baseline without authority or thresholds: owner pairs looked at, pairs without a path."""
    owners = owns_facts(edges).select("module_key", "owner_key", "confidence")
    pairs = durable(owner_pairs(edges, owners))
    distances = G.pair_distances(
        G.communication_graph(nodes, edges),
        pairs.select(F.col("source_owner_key").alias("a"), F.col("target_owner_key").alias("b")),
        max_len,
    )
    keyed = pairs.select(
        F.least("source_owner_key", "target_owner_key").alias("a"),
        F.greatest("source_owner_key", "target_owner_key").alias("b"),
    )
    return keyed.join(distances, ["a", "b"], "left").agg(
        F.count("*").alias("round_trips"),
        F.count_if((F.col("a") != F.col("b")) & F.col("distance").isNull()).alias(
            "open_faultline_pairs"
        ),
    )


def baseline_owners(edges: DataFrame) -> DataFrame:
    """Per module the first OWNS edge in id order beside the one of highest authority."""
    owns = owns_facts(edges)
    return owns.groupBy("module_key").agg(
        F.min_by("owner_key", F.struct("id", "canonical_key")).alias("first_owner"),
        F.min_by("owner_key", F.struct((-F.col("authority_rank")).alias("a"), "owner_key")).alias(
            "authority_owner"
        ),
    )


# --- missing records --------------------------------------------------------


def gap_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``phantom_key, side, artifact_key``: neighbours of each phantom, one per row."""
    phantoms = nodes.where("label = 'Phantom'").select(F.col("canonical_key").alias("phantom_key"))
    ends = edges.where(F.col("rel_type").isin("PRECEDED_BY", "REPLIES_TO")).select(
        "rel_type", "source_key", "target_key"
    )
    before = ends.where("rel_type = 'PRECEDED_BY'").select(
        F.col("source_key").alias("phantom_key"),
        F.lit("predecessor").alias("side"),
        F.col("target_key").alias("artifact_key"),
    )
    after = ends.select(
        F.col("target_key").alias("phantom_key"),
        F.lit("successor").alias("side"),
        F.col("source_key").alias("artifact_key"),
    )
    return before.unionByName(after).join(phantoms, "phantom_key", "left_semi")


def gap_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per phantom. Its neighbours stay in ``gap_links``; here are their numbers,
    the first of each side, and the epoch between them."""
    links = gap_links(nodes, edges)
    epochs = nodes.select(
        F.col("canonical_key").alias("artifact_key"), F.col("props.created_epoch").alias("epoch")
    )
    on = lambda side, value: F.when(F.col("side") == side, value)
    summary = (
        links.join(epochs, "artifact_key", "left")
        .groupBy("phantom_key")
        .agg(
            F.count(on("predecessor", F.lit(1))).alias("predecessors"),
            F.count(on("successor", F.lit(1))).alias("successors"),
            F.min(on("predecessor", F.col("artifact_key"))).alias("first_predecessor"),
            F.min(on("successor", F.col("artifact_key"))).alias("first_successor"),
            F.max(on("predecessor", F.col("epoch"))).alias("latest_before"),
            F.min(on("successor", F.col("epoch"))).alias("earliest_after"),
        )
    )
    phantoms = nodes.where("label = 'Phantom'").select(
        F.col("id").alias("node_id"),
        F.col("canonical_key").alias("phantom_key"),
        F.coalesce("props.expected_kind", F.lit("unknown")).alias("expected_kind"),
        F.coalesce("props.reason", F.lit("unknown")).alias("reason"),
        F.col("props.inferred_epoch").alias("stated_epoch"),
        F.coalesce("props.window_position", F.lit("unknown")).alias("window_position"),
        F.col("props.days_after_corpus_start").alias("days_after_corpus_start"),
    )
    between = half_even((F.col("latest_before") + F.col("earliest_after")) / 2)
    return phantoms.join(summary, "phantom_key", "left").select(
        "phantom_key",
        "expected_kind",
        "reason",
        F.coalesce("stated_epoch", between).alias("inferred_epoch"),
        F.coalesce("predecessors", F.lit(0)).alias("predecessors"),
        F.coalesce("successors", F.lit(0)).alias("successors"),
        "first_predecessor",
        "first_successor",
        "window_position",
        "days_after_corpus_start",
    )


def gap_order() -> list[Column]:
    return [
        F.asc(F.col("window_position") != "in_window"),
        F.desc(F.coalesce("days_after_corpus_start", F.lit(0))),
        F.asc("phantom_key"),
    ]


def gap_listing(findings: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` findings, contract gaps first, with the totals over all of them."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    totals = findings.agg(
        F.count("*").alias("total_findings"),
        F.count_if(F.col("window_position") == "in_window").alias("in_window"),
        F.count_if(F.col("window_position") == "export_boundary").alias("at_boundary"),
    )
    shown = findings.orderBy(
        F.col("reason") == "dangling_thread_parent",
        F.col("window_position") == "export_boundary",
        F.desc(F.coalesce("days_after_corpus_start", F.lit(0))),
        "phantom_key",
    ).limit(limit)
    return shown.select(
        "*", *[totals.select(name).scalar().alias(name) for name in totals.columns]
    )


def gaps_between(links: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Phantoms with the source among their successors and the target among their predecessors."""
    ends = links.where(
        ((F.col("side") == "successor") & (F.col("artifact_key") == source_key))
        | ((F.col("side") == "predecessor") & (F.col("artifact_key") == target_key))
    )
    return ends.groupBy("phantom_key").agg(
        F.max(F.col("side") == "successor").alias("s"), F.max(F.col("side") == "predecessor").alias("p")
    ).where("s AND p").select("phantom_key")


def gap_chains(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_len: int = 8) -> DataFrame:
    """``a, b, path, phantom_indices``: shortest PRECEDED_BY chains of the pairs, at most 20 each."""
    arcs = edges.where("rel_type = 'PRECEDED_BY'").select(
        F.col("source_key").alias("src"), F.col("target_key").alias("dst")
    )
    ends = arcs.select(F.col("src").alias("v"))
    forward = G.build_graph(arcs, ends, directed=True)
    backward = G.build_graph(
        arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends, directed=True
    )
    paths = G.all_shortest_paths(forward, pairs, max_len, backward)
    kept = top_per_group(paths, ["a", "b"], [F.col("path")], 20)
    phantoms = nodes.where("label = 'Phantom'").select(F.col("canonical_key").alias("step"))
    places = (
        kept.select("a", "b", "position", F.posexplode("path").alias("place", "step"))
        .join(phantoms, "step", "left_semi")
        .groupBy("a", "b", "position")
        .agg(F.array_sort(F.collect_list("place")).alias("phantom_indices"))
    )
    return kept.join(places, ["a", "b", "position"], "left").select(
        "a",
        "b",
        "position",
        "path",
        F.coalesce("phantom_indices", F.array().cast("array<int>")).alias("phantom_indices"),
    )


# --- evidence of findings ---------------------------------------------------


def first_evidence(cited: DataFrame, evidence: DataFrame, limit: int = EVIDENCE_SHOWN) -> DataFrame:
    """The first ``limit`` evidence rows per finding, from ``finding_key, part, edge_id, evidence_id``.

    A record cited twice keeps its first place.
    """
    order = F.struct("part", "edge_id", "evidence_id")
    places = cited.groupBy("finding_key", "evidence_id").agg(F.min(order).alias("place"))
    known = places.join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    shown = top_per_group(known, ["finding_key"], [F.col("place")], limit)
    details = evidence.select(
        "evidence_id",
        "source_type",
        "source_uri",
        "source_record_id",
        "predicate",
        "subject_key",
        "object_key",
        "evidence_class",
        "confidence",
        "content_sha256",
        "redacted_excerpt",
    )
    return shown.select("finding_key", "position", "evidence_id").join(details, "evidence_id")


def cite_nodes(findings: DataFrame, key: str, node_evidence: DataFrame) -> DataFrame:
    """Evidence of the node each finding is about."""
    return findings.select(F.col(key).alias("finding_key"), F.col(key).alias("node_key")).distinct().join(
        node_evidence.select("node_key", "evidence_id"), "node_key"
    ).select("finding_key", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("edge_id"), "evidence_id")


def faultline_key() -> Column:
    return F.concat_ws(
        "|", "source_module_key", "target_module_key", "source_owner_key", "target_owner_key"
    )


def cite_faultlines(findings: DataFrame, edges: DataFrame, edge_evidence: DataFrame) -> DataFrame:
    """Evidence of a faultline: the dependency, then each owner's claim."""
    keyed = findings.select(
        faultline_key().alias("finding_key"),
        F.explode(
            F.array(
                _claim(0, "source_module_key", "target_module_key", "DEPENDS_ON"),
                _claim(1, "source_owner_key", "source_module_key", "OWNS"),
                _claim(2, "target_owner_key", "target_module_key", "OWNS"),
            )
        ).alias("claim"),
    ).select("finding_key", "claim.*").distinct()
    claims = edges.where(F.col("rel_type").isin("DEPENDS_ON", "OWNS")).select(
        F.col("id").alias("edge_id"),
        F.col("canonical_key").alias("edge_key"),
        "rel_type",
        "source_key",
        "target_key",
    )
    return (
        keyed.join(claims, ["rel_type", "source_key", "target_key"])
        .join(edge_evidence.select("edge_key", "evidence_id"), "edge_key")
        .select("finding_key", "part", "edge_id", "evidence_id")
    )


def _claim(part: int, source: str, target: str, rel_type: str) -> Column:
    return F.struct(
        F.lit(part).alias("part"),
        F.col(source).alias("source_key"),
        F.col(target).alias("target_key"),
        F.lit(rel_type).alias("rel_type"),
    )


def with_bridges(findings: DataFrame, graph: G.Graph, max_len: int = 4) -> DataFrame:
    """Faultlines with one shortest communication path between the owners."""
    paths = G.first_bridges(
        graph,
        findings.select(F.col("source_owner_key").alias("a"), F.col("target_owner_key").alias("b")),
        max_len,
    ).select(
        F.col("a").alias("source_owner_key"),
        F.col("b").alias("target_owner_key"),
        F.col("path").alias("bridge"),
    )
    return findings.join(paths, ["source_owner_key", "target_owner_key"], "left")


# --- counts and display -----------------------------------------------------


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by label and edges by (source label, type, target label), each with its total."""
    labels = nodes.select("canonical_key", "label")
    by_label = nodes.rollup("label").agg(F.count("*").alias("n")).select(
        F.lit("nodes").alias("what"),
        F.coalesce("label", F.lit("*")).alias("source_label"),
        F.lit("").alias("rel_type"),
        F.lit("").alias("target_label"),
        "n",
    )
    shapes = _edge_shapes(edges, labels)
    total = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("edges").alias("what"),
        F.lit("*").alias("source_label"),
        F.lit("*").alias("rel_type"),
        F.lit("*").alias("target_label"),
        "n",
    )
    return union_all(by_label, shapes.select(F.lit("edges").alias("what"), "*"), total)


def _edge_shapes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``source_label, rel_type, target_label, n`` of the edges whose ends are nodes.

    Ends at people, teams, modules and phantoms are labelled where the edges are, and edges without
    other ends are counted there. The others are counted for each artifact and joined to these.
    """
    names = ["source_label", "rel_type", "target_label"]
    near, ends = few(near_nodes(labels)), edges.select("source_key", "target_key", "rel_type")
    for end in ("source", "target"):
        ends = ends.join(near.toDF(f"{end}_key", f"{end}_label"), f"{end}_key", "left")
    for end in ("source", "target"):
        ends = ends.withColumn(f"{end}_key", F.when(F.col(f"{end}_label").isNull(), F.col(f"{end}_key")))
    counts = ends.groupBy(*names, "source_key", "target_key").agg(F.count("*").alias("n"))
    far = labels.where(F.startswith("canonical_key", F.lit(ARTIFACT))).toDF("key", "label")
    at_target = F.col("target_key").isNotNull()
    first = counts.withColumn("key", F.coalesce("target_key", "source_key")).join(far, "key", "left").select(
        F.coalesce("source_label", F.when(~at_target, F.col("label"))).alias("source_label"),
        "rel_type",
        F.coalesce("target_label", F.when(at_target, F.col("label"))).alias("target_label"),
        F.when(at_target, F.col("source_key")).alias("key"),
        "n",
    )
    left = first.groupBy(*names, "key").agg(F.sum("n").alias("n"))
    second = left.join(far, "key", "left").withColumn("source_label", F.coalesce("source_label", "label"))
    known = second.where("source_label IS NOT NULL AND target_label IS NOT NULL")
    return known.groupBy(*names).agg(F.sum("n").alias("n"))


def _clamped(value: Column) -> Column:
    return F.greatest(F.lit(MIN_NODE_SIZE), F.least(F.lit(MAX_NODE_SIZE), value)).cast("bigint")


def graph_nodes(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Resolved people with display sizes; the widest rank gap of the first ten is selected."""
    selected = scalar(
        scores.where(F.col("structural_rank") <= 10),
        F.max_by("person_key", F.struct("rank_gap", (-F.col("structural_rank")).alias("r"))),
    )
    team = F.regexp_replace(F.coalesce("props.team_id", F.lit("team:unknown")), "^team:", "")
    rank = F.greatest(F.coalesce("props.role_rank", F.lit(0)), F.lit(0))
    team_name = capitalize(F.replace(team, F.lit("-"), F.lit(" ")))
    role = F.lit("member")
    for value, title in ROLE_TITLES.items():
        role = F.when(rank == value, F.lit(title)).otherwise(role)
    joined = G.resolved_people(nodes).join(
        scores.select(
            F.col("person_key").alias("canonical_key"), "sampled_centrality", "communication_degree"
        ),
        "canonical_key",
        "left",
    )
    actual = (
        MIN_NODE_SIZE
        + F.coalesce("sampled_centrality", F.lit(0.0)) * 250
        + F.coalesce("communication_degree", F.lit(0)) * 3
    )
    return joined.select(
        F.col("canonical_key").alias("node_key"),
        F.coalesce("props.display_name", "canonical_key").alias("name"),
        F.when(rank >= 6, F.concat(F.lit("VP, "), team_name))
        .otherwise(F.concat(team_name, F.lit(" "), role))
        .alias("title"),
        team.alias("team"),
        _clamped(22 + rank * 10).alias("official_size"),
        _clamped(F.rint(actual)).alias("actual_size"),
        (F.col("canonical_key") == selected).alias("selected"),
    )


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """COMMUNICATES between resolved people with a strength class."""
    people = G.resolved_people(nodes).select("canonical_key")
    weight = F.coalesce("props.weight", F.lit(0))
    return (
        edges.where("rel_type = 'COMMUNICATES'")
        .join(people.withColumnRenamed("canonical_key", "source_key"), "source_key", "left_semi")
        .join(people.withColumnRenamed("canonical_key", "target_key"), "target_key", "left_semi")
        .select(
            F.col("source_key").alias("source"),
            F.col("target_key").alias("target"),
            F.when(weight >= 5, F.lit("strong"))
            .when(weight >= 3, F.lit("medium"))
            .otherwise(F.lit("weak"))
            .alias("strength"),
        )
    )
