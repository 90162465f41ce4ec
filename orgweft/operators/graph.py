"""Path work on the communication graph: level-synchronous DataFrame joins.

Vertices are numbered in the order of their keys, and walks carry numbers only; comparing
numbers is comparing keys. A walk's state holds every row reached so far. One level joins the
state to the arcs, among them a loop at each vertex that brings a row's own values along, and
aggregates by row; so a level uses the state before it once, and a few levels are one job
without a stored table between them.

Where shortest paths are counted over many sources and the arcs are few, tasks that hold all arcs
walk one source after another (``paths``) instead.

Where only "reached or not" matters, 64 sources share a row: one bit each, combined by
``bit_or``. Distances and single paths of pairs are searched from both ends at once, each half
as far, and joined in the middle. Where shortest paths are counted, sources are walked in
blocks; each block is reduced to one value per vertex and its state removed before the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.functions.permutation import draws
from orgweft.functions.ranking import global_row_number, top_per_group
from orgweft.operators import paths as P
from orgweft.operators.normalize import union_all
from orgweft.session import Scratch, durable, stored

# Above this many arcs (of four numbers each) they are joined by a shuffle instead of being sent to
# every task.
BROADCAST_ARCS = 2_000_000
# Arcs of one vertex that share a join partition; a hub's arcs fill several slots.
ARCS_PER_SLOT = 10_000
# State rows that the sources of one block may reach together; with the rows that one level moves,
# they are what a walk holds on disk.
BLOCK_ROWS = 50_000_000
# State rows that all sources may reach before tasks with all arcs walk them one by one.
ROWS_AS_FRAMES = 500_000
# Rows of 64 sources each that are walked together.
WORDS_PER_WALK = 50_000
# Levels that one job takes; beyond, the state is stored.
LEVELS_PER_JOB = 4


@dataclass(frozen=True)
class Graph:
    """``vertices``: v, no, slots; ``no`` counts from 1 in the order of v. ``arcs``: src, slot,
    dst, dst_slots by number (no loops). ``named_arcs``: src, dst by key.
    """

    arcs: DataFrame
    vertices: DataFrame
    named_arcs: DataFrame
    size: int
    small: bool
    directed: bool = False

    def expand(self, frontier: DataFrame, arcs: DataFrame | None = None, when: Column | None = None) -> DataFrame:
        """Frontier rows (``v, slots``) joined to the arcs that leave their vertex.

        A hub's frontier rows are copied to each of its slots, so no join partition
        holds more than one slot of a vertex.
        """
        arcs = self.arcs if arcs is None else arcs
        when = F.lit(True) if when is None else when
        if self.small:
            return frontier.drop("slots").join(F.broadcast(arcs.drop("slot")), (F.col("v") == F.col("src")) & when)
        spread = frontier.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        return spread.drop("slots").join(
            arcs, (F.col("v") == F.col("src")) & (F.col("at") == F.col("slot")) & when
        ).drop("at", "slot")

    def step(self, state: DataFrame, moving: Column) -> DataFrame:
        """Each state row once at its own vertex (``own``), and ``moving`` ones at all neighbours
        (``dst, dst_slots``).
        """
        loops = self.vertices.select(
            F.col("no").alias("src"),
            F.lit(0).alias("slot"),
            F.col("no").alias("dst"),
            F.col("slots").alias("dst_slots"),
        )
        own = F.col("src") == F.col("dst")
        return self.expand(state, self.arcs.unionByName(loops), own | moving).withColumn("own", own)

    def gathered(self, state: DataFrame) -> DataFrame:
        """The state with all rows of a source in one partition.

        Where arcs are broadcast, its levels then need no shuffle: joins keep the partitions, and
        rows are grouped by source and vertex. A number of partitions keeps few first rows spread.
        """
        if not self.small:
            return state
        return state.repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s")

    def numbers(self, keys: DataFrame, name: str, number: str) -> DataFrame:
        """``keys`` with the vertex number of a column; keys that are no vertices fall out."""
        return keys.join(self.vertices.select(F.col("v").alias(name), F.col("no").alias(number)), name)


def build_graph(arcs: DataFrame, vertices: DataFrame, *, directed: bool = False) -> Graph:
    """From distinct ``src, dst`` and ``v``. Endpoints without a vertex row are added."""
    plain = arcs.where("src <> dst").select("src", "dst")
    if not directed:
        plain = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    plain = stored(plain.distinct(), "arcs")
    slots = F.ceil(F.count("*") / F.lit(ARCS_PER_SLOT)).cast("int")
    degrees = plain.groupBy(F.col("src").alias("v")).agg(slots.alias("slots"))
    everyone = vertices.select("v").union(plain.select("src")).union(plain.select("dst")).distinct()
    listed = everyone.join(degrees, "v", "left").select("v", F.coalesce("slots", F.lit(1)).alias("slots"))
    listed = stored(
        global_row_number(listed, [F.col("v")], "no").select("v", F.col("no").cast("bigint").alias("no"), "slots"),
        "vertices",
    )
    ends = listed.select(F.col("v").alias("dst"), F.col("no").alias("dst_no"), F.col("slots").alias("dst_slots"))
    hubs = listed.select(F.col("v").alias("src"), F.col("no").alias("src_no"), F.col("slots").alias("src_slots"))
    slotted = stored(
        plain.join(hubs, "src")
        .join(ends, "dst")
        .select(
            F.col("src_no").alias("src"),
            F.pmod(F.xxhash64("dst_no"), F.col("src_slots")).cast("int").alias("slot"),
            F.col("dst_no").alias("dst"),
            "dst_slots",
        ),
        "numbered_arcs",
    )
    return Graph(
        arcs=slotted,
        vertices=listed,
        named_arcs=plain,
        size=listed.count(),
        small=slotted.count() <= BROADCAST_ARCS,
        directed=directed,
    )


def communication_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Undirected projection of COMMUNICATES over resolved people and any other endpoints."""
    pairs = edges.where(F.col("rel_type") == "COMMUNICATES").select(
        F.col("source_key").alias("src"), F.col("target_key").alias("dst")
    )
    return build_graph(pairs, resolved_people(nodes).select(F.col("canonical_key").alias("v")))


def directed_communication(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed weighted projection: source, target, weight (1 when none is recorded)."""
    return edges.where(F.col("rel_type") == "COMMUNICATES").select(
        "source_key", "target_key", F.coalesce("props.weight", F.lit(1)).alias("weight")
    )


def resolved_people(nodes: DataFrame) -> DataFrame:
    return nodes.where(
        (F.col("label") == "Person")
        & (F.coalesce(F.col("props.identity_status"), F.lit("")) != "unresolved")
    )


# --- walks that count shortest paths ----------------------------------------


def all_sources(graph: Graph) -> DataFrame:
    return graph.vertices.select(F.col("v").alias("s"))


def _rounds(level: int, last: int | None) -> bool:
    """Whether the state is stored after a level."""
    return level % LEVELS_PER_JOB == 0 or level == last


def _walk(graph: Graph, sources: DataFrame, shelf: Scratch, max_len: int | None = None) -> tuple[DataFrame, int]:
    """State ``s, v, slots, d, sigma`` of numbered sources ``s``, and its largest distance.

    ``sigma`` counts the shortest paths from s to v.
    """
    if max_len is not None and max_len <= 0:
        raise ValueError("max_len must be positive")
    state = sources.join(graph.vertices, F.col("s") == F.col("no")).select(
        "s", F.col("no").alias("v"), "slots", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")
    )
    state = graph.gathered(state)
    level = 0
    while True:
        state = (
            graph.step(state, F.col("d") == level)
            .groupBy("s", F.col("dst").alias("v"))
            .agg(
                F.max("dst_slots").alias("slots"),
                F.min(F.when(F.col("own"), F.col("d"))).alias("d"),
                F.sum(F.when(F.col("own"), F.col("sigma"))).alias("sigma"),
                F.sum(F.when(~F.col("own"), F.col("sigma"))).alias("paths"),
            )
            .select(
                "s",
                "v",
                "slots",
                F.coalesce("d", F.lit(level + 1)).alias("d"),
                F.coalesce("sigma", "paths").alias("sigma"),
            )
        )
        level += 1
        if _rounds(level, max_len):
            state = shelf.step(state, "walk")
            if level == max_len or state.where(F.col("d") == level).isEmpty():
                break
            state = graph.gathered(state)
    return state, state.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]


def _dependencies(graph: Graph, state: DataFrame, top: int, shelf: Scratch, keys: tuple[str, ...] = ("s",)) -> DataFrame:
    """The state with ``delta``: how much of the paths from s to other vertices leads over v."""
    current = graph.gathered(state).withColumn("delta", F.lit(0.0))
    mine = lambda name: F.max(F.when(F.col("own"), F.col(name))).alias(name)
    for done, level in enumerate(range(top, 1, -1), 1):
        share = F.when(~F.col("own"), (1 + F.col("delta")) / F.col("sigma"))
        current = (
            graph.step(current, F.col("d") == level)
            .groupBy(*keys, F.col("dst").alias("v"))
            .agg(F.max("dst_slots").alias("slots"), mine("d"), mine("sigma"), mine("delta"), F.sum(share).alias("share"))
            .where("d IS NOT NULL")
            .select(
                *keys,
                "v",
                "slots",
                "d",
                "sigma",
                F.when(F.col("d") == level - 1, F.col("sigma") * F.coalesce("share", F.lit(0.0)))
                .otherwise(F.col("delta"))
                .alias("delta"),
            )
        )
        if done % LEVELS_PER_JOB == 0:
            current = graph.gathered(shelf.step(current, "dependencies"))
    return current


def _blocks(graph: Graph, numbered: DataFrame, copies: int = 1) -> list[DataFrame]:
    """Sources ``s`` in blocks that reach ``BLOCK_ROWS`` vertices at most, each in so many copies."""
    own = max(1, BLOCK_ROWS // max(1, graph.size * copies))
    blocks = max(1, -(-numbered.count() // own))
    if blocks == 1:
        return [numbered]
    return [numbered.where(F.pmod("s", F.lit(blocks)) == block) for block in range(blocks)]


def _one_by_one(graph: Graph, sources: int) -> bool:
    return graph.small and graph.size * sources > ROWS_AS_FRAMES


def _tallied(graph: Graph, numbered: DataFrame, bounds: tuple[int, ...], pairs: bool = False) -> DataFrame:
    """``bound, v, tally, n`` over all sources, each walked by a task that holds the arcs."""
    spark = graph.vertices.sparkSession
    shared = spark.sparkContext.broadcast(P.held_arcs(graph.arcs))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = numbered.select("s").repartition(tasks, "s").mapInArrow(P.tallier(shared, bounds, pairs), P.ROWS)
    return stored(found.groupBy("bound", "v").agg(F.sum("tally").alias("tally"), F.sum("n").alias("n")), "tally")


def path_tallies(
    graph: Graph, sources: DataFrame, max_len: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(``v, tally``, ``pairs, ordered_pairs``): summed path dependencies and pairs reached.

    ``tally`` sums over ordered pairs; halve it for unordered ones. ``pairs`` counts
    unordered pairs with a source at one end. Each block of sources leaves one row per vertex.
    """
    spark = graph.vertices.sparkSession
    numbered = stored(graph.numbers(sources.select("s").distinct(), "s", "no").select(F.col("no").alias("s")), "sources")
    if max_len is not None and max_len <= 0:
        raise ValueError("max_len must be positive")
    found = []
    if _one_by_one(graph, numbered.count()):
        found.append(_tallied(graph, numbered, (max_len or P.UNBOUND,)).drop("bound"))
    for own in [] if found else _blocks(graph, numbered):
        with Scratch(spark) as shelf:
            state, top = _walk(graph, own, shelf, max_len)
            deltas = _dependencies(graph, state, top, shelf).where("d > 0")
            found.append(
                stored(deltas.groupBy("v").agg(F.sum("delta").alias("tally"), F.count("*").alias("n")), "tally")
            )
    summed = union_all(*found).groupBy("v").agg(F.sum("tally").alias("tally"), F.sum("n").alias("n"))
    names = graph.vertices.select("v", "no")
    tally = summed.join(names.withColumnRenamed("v", "key"), F.col("v") == F.col("no")).select(
        F.col("key").alias("v"), "tally"
    )
    # A pair of two sources is met from both ends; a pair with one source only once.
    is_source = numbered.select(F.col("s").alias("v"), F.lit(1).alias("mine"))
    count = summed.join(is_source, "v", "left").agg(
        F.coalesce(
            F.sum(F.when(F.col("mine") == 1, F.col("n") / 2).otherwise(F.col("n"))), F.lit(0)
        )
        .cast("bigint")
        .alias("pairs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("ordered_pairs"),
    )
    return tally, count


def betweenness_exact(graph: Graph) -> DataFrame:
    """``v, centrality``: exact, unweighted, undirected, divided by (n-1)(n-2)."""
    tally, _pairs = path_tallies(graph, all_sources(graph))
    scale = max(1, (graph.size - 1) * (graph.size - 2))
    return graph.vertices.select("v").join(tally, "v", "left").select(
        "v", (F.coalesce("tally", F.lit(0.0)) / F.lit(float(scale))).alias("centrality")
    )


def betweenness_bounded(graph: Graph, sources: DataFrame, max_len: int) -> DataFrame:
    """``v, centrality``: paths of at most ``max_len`` hops, halved, over the pairs reached."""
    tally, pairs = path_tallies(graph, sources, max_len)
    total = F.greatest(pairs.select("pairs").scalar(), F.lit(1)).cast("double")
    return graph.vertices.select("v").join(tally, "v", "left").select(
        "v", (F.coalesce("tally", F.lit(0.0)) / 2 / total).alias("centrality")
    )


def length_sweep(graph: Graph, lengths: range, top: int, baseline: int = 4) -> DataFrame:
    """Per bound: pairs reached, the first people, overlap of the first ``top`` with the baseline.

    One forward walk serves every bound, and one backward pass carries the bounds side by side.
    Sources are walked in blocks.
    """
    every = F.array(*[F.lit(bound) for bound in lengths])
    within = F.filter(every, lambda bound: bound >= F.col("d"))
    reached, tallied = [], []
    everyone = graph.vertices.select(F.col("no").alias("s"))
    if _one_by_one(graph, graph.size):
        rows = _tallied(graph, everyone, tuple(lengths), pairs=True)
        reached.append(rows.where(F.col("bound") == P.PAIRS).select(F.col("v").cast("int").alias("d"), "n"))
        tallied.append(rows.where(F.col("bound") != P.PAIRS).select(F.col("bound").alias("max_len"), "v", "tally"))
    for own in [] if reached else _blocks(graph, everyone, len(lengths)):
        with Scratch(graph.vertices.sparkSession) as shelf:
            state, deepest = _walk(graph, own, shelf, max(lengths))
            reached.append(
                stored(state.where("s < v").groupBy("d").agg(F.count("*").alias("n")), "pairs_by_distance")
            )
            runs = state.withColumn("max_len", F.explode(within))
            deltas = _dependencies(graph, runs, deepest, shelf, ("max_len", "s")).where("d > 0")
            tallied.append(stored(deltas.groupBy("max_len", "v").agg(F.sum("delta").alias("tally")), "tallies"))
    pairs = union_all(*reached)
    tally = union_all(*tallied).groupBy("max_len", "v").agg(F.sum("tally").alias("tally"))
    everyone = graph.vertices.select(F.col("v").alias("key"), F.col("no").alias("v"), F.explode(every).alias("max_len"))
    ranked = everyone.join(tally, ["max_len", "v"], "left").select(
        "max_len", F.col("key").alias("v"), F.round(F.coalesce("tally", F.lit(0.0)) / 2, 6).alias("tally")
    )
    firsts = durable(top_per_group(ranked, ["max_len"], [F.desc("tally"), F.asc("v")], top))
    totals = pairs.select(F.explode(within).alias("max_len"), "n").groupBy("max_len").agg(
        F.sum("n").alias("reachable_pairs")
    )
    base = firsts.where(F.col("max_len") == baseline).select("v")
    shared = firsts.join(base, "v", "left_semi").groupBy("max_len").agg(F.count("*").alias("shared"))
    sizes = firsts.groupBy("max_len").agg(F.min_by("v", F.struct(-F.col("tally"), "v")).alias("top_1"))
    base_size = F.greatest(F.lit(1), base.select(F.count("*")).scalar())
    return (
        sizes.join(totals, "max_len", "left")
        .join(shared, "max_len", "left")
        .select(
            "max_len",
            F.coalesce("reachable_pairs", F.lit(0)).alias("reachable_pairs"),
            "top_1",
            F.round(F.coalesce("shared", F.lit(0)) / base_size, 3).alias("overlap"),
        )
    )


# --- 64 sources a row -------------------------------------------------------


def _word(number: str) -> Column:
    return F.expr(f"{number} div 64").alias("word")


def _bit(number: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({number} % 64 AS INT))")


def _reach(graph: Graph, sources: DataFrame, radius: int) -> DataFrame:
    """``g, word, v, slots, l0..l<radius>``: which sources of a word have v at each distance.

    ``sources``: g (number of a vertex that is not walked, or 0) and s.
    """
    state = (
        sources.where("g <> s")
        .join(graph.vertices.select(F.col("no").alias("s"), "slots"), "s")
        .select("g", _word("s"), F.col("s").alias("v"), "slots", _bit("s").alias("l0"))
    )
    for level in range(radius):
        done = [f"l{n}" for n in range(level + 1)]
        seen = F.lit(0).cast("bigint")
        for name in done:
            seen = seen.bitwiseOR(F.coalesce(name, F.lit(0).cast("bigint")))
        state = (
            graph.step(state, (F.col(done[-1]) != 0) & (F.col("dst") != F.col("g")))
            .groupBy("g", "word", F.col("dst").alias("v"))
            .agg(
                F.max("dst_slots").alias("slots"),
                *[F.bit_or(F.when(F.col("own"), F.col(name))).alias(name) for name in done],
                F.bit_or(F.when(~F.col("own"), F.col(done[-1]))).alias("new"),
            )
            .select(
                "g",
                "word",
                "v",
                "slots",
                *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in done],
                F.coalesce("new", F.lit(0).cast("bigint")).bitwiseAND(F.bitwise_not(seen)).alias(f"l{level + 1}"),
            )
        )
    return state


def reachable_pairs(
    graph: Graph, max_len: int, removed: DataFrame | None = None, endpoints: DataFrame | None = None
) -> DataFrame:
    """``g, pairs``: unordered pairs joined within ``max_len`` hops.

    ``removed`` (column ``g``) gives one variant of the graph per person taken out; the
    empty ``g`` is the whole graph. ``endpoints`` (column ``v``) limits the pairs' ends,
    not the paths between them. The graph must be undirected: each pair is met from both ends.
    """
    if max_len <= 0:
        raise ValueError("max_len must be positive")
    ends = graph.vertices.select(F.col("no").alias("s"))
    if endpoints is not None:
        ends = graph.numbers(endpoints.select("v").distinct(), "v", "s").select("s")
    if removed is None:
        variants = graph.arcs.sparkSession.range(1).select(F.lit("").alias("g"), F.lit(0).cast("bigint").alias("no"))
        sources, copies = ends.select(F.lit(0).cast("bigint").alias("g"), "s"), 1
    else:
        known = graph.vertices.select(F.col("v").alias("g"), "no")
        variants = removed.select("g").distinct().join(known, "g", "left").select(
            "g", F.coalesce("no", F.lit(0)).alias("no")
        )
        variants = stored(variants, "variants")
        # One copy of the sources per removed person: the variants asked for, not a product
        # of two data sets.
        out = variants.agg(F.collect_set("no").alias("gs")).select("gs").scalar()
        sources, copies = ends.select(F.explode(out).alias("g"), "s"), variants.count()
    walks = max(1, -(-(graph.size // 64 + 1) * copies // WORDS_PER_WALK))
    counts = []
    for walk in range(walks):
        own = sources if walks == 1 else sources.where(F.pmod(F.expr("s div 64"), F.lit(walks)) == walk)
        met = _reach(graph, own, max_len)
        if endpoints is not None:
            met = met.join(ends.withColumnRenamed("s", "v"), "v", "left_semi")
        reached = F.lit(0)
        for level in range(1, max_len + 1):
            reached = reached + F.bit_count(f"l{level}")
        part = met.groupBy("g").agg(F.sum(reached).alias("n"))
        counts.append(part if walks == 1 else stored(part, "reached"))
    summed = union_all(*counts).groupBy(F.col("g").alias("no")).agg((F.sum("n") / 2).cast("bigint").alias("pairs"))
    return variants.join(summed, "no", "left").select(
        "g", F.coalesce("pairs", F.lit(0).cast("bigint")).alias("pairs")
    )


# --- distances and paths of pairs -------------------------------------------


def pair_distances(graph: Graph, pairs: DataFrame, max_len: int) -> DataFrame:
    """``a, b, distance`` for unordered pairs (a <= b) of an undirected graph; null beyond
    ``max_len`` hops.

    Both ends are walked half as far, 64 ends to a row, and meet at the vertices that both
    reach; the smallest sum of two distances is the distance.
    """
    if max_len <= 0:
        raise ValueError("max_len must be positive")
    wanted = stored(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"
    )
    keyed = stored(
        graph.numbers(graph.numbers(wanted, "a", "s"), "b", "t").select(
            "a", "b", "s", "t", _word("s"), _bit("s").alias("bit")
        ),
        "numbered_pairs",
    )
    near, far = max_len - max_len // 2, max_len // 2
    side = lambda name, radius: _reach(
        graph, keyed.select(F.lit(0).cast("bigint").alias("g"), F.col(name).alias("s")).distinct(), radius
    )
    merged = lambda state, radius: state.groupBy("word", "v").agg(
        *[F.bit_or(f"l{n}").alias(f"l{n}") for n in range(radius + 1)]
    )
    from_s = merged(side("s", near), near)
    # The far side one row per end again: its distance to a vertex picks the level of the near side.
    places = F.expr("sequence(0, 63)")
    levels = F.array(*[F.struct(F.lit(n).alias("dt"), F.col(f"l{n}").alias("bits")) for n in range(far + 1)])
    from_t = (
        merged(side("t", far), far)
        .select("word", "v", F.explode(levels).alias("x"))
        .where("x.bits <> 0")
        .select("word", "v", "x.*", F.explode(places).alias("place"))
        .where("shiftright(bits, place) & 1 = 1")
        .select((F.col("word") * 64 + F.col("place")).alias("t"), "v", "dt")
    )
    asked = keyed.groupBy("t", "word").agg(F.bit_or("bit").alias("bits"))
    at = F.array(*[F.col(f"l{n}") for n in range(near + 1)])
    met = (
        asked.join(from_t, "t")
        .join(from_s, ["word", "v"])
        .groupBy("t", "word")
        .agg(
            *[
                F.bit_or(F.get(at, F.lit(total) - F.col("dt")).bitwiseAND(F.col("bits"))).alias(f"d{total}")
                for total in range(max_len + 1)
            ]
        )
    )
    distance = F.coalesce(
        *[F.when(F.col(f"d{total}").bitwiseAND(F.col("bit")) != 0, F.lit(total)) for total in range(max_len + 1)]
    )
    found = keyed.join(met, ["t", "word"]).select("a", "b", distance.alias("distance"))
    return wanted.join(found, ["a", "b"], "left")


def _named(graph: Graph, paths: DataFrame) -> DataFrame:
    """``a, b, path`` by key, from distinct ``path`` arrays of numbers."""
    steps = paths.select("path", F.posexplode("path").alias("place", "no"))
    return (
        steps.join(graph.vertices.select("no", "v"), "no")
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("x"))
        .select(F.col("x.v").alias("path"))
        .select(F.get("path", F.lit(0)).alias("a"), F.element_at("path", -1).alias("b"), "path")
    )


def _first_paths(graph: Graph, ends: DataFrame, radius: int, towards: bool) -> DataFrame:
    """``s, v, d, path``: the smallest of the shortest paths from s to v, or from v ``towards`` s."""
    state = ends.join(graph.vertices, F.col("s") == F.col("no")).select(
        "s", F.col("no").alias("v"), "slots", F.lit(0).alias("d"), F.array("no").alias("path")
    )
    for level in range(radius):
        here = F.array("dst")
        longer = F.concat(here, "path") if towards else F.concat("path", here)
        state = (
            graph.step(state, F.col("d") == level)
            .groupBy("s", F.col("dst").alias("v"))
            .agg(
                F.max("dst_slots").alias("slots"),
                F.min(F.when(F.col("own"), F.col("d"))).alias("d"),
                F.min(F.when(F.col("own"), F.col("path"))).alias("path"),
                F.min(F.when(~F.col("own"), longer)).alias("longer"),
            )
            .select(
                "s",
                "v",
                "slots",
                F.coalesce("d", F.lit(level + 1)).alias("d"),
                F.coalesce("path", "longer").alias("path"),
            )
        )
    return state


def first_bridges(graph: Graph, pairs: DataFrame, max_len: int = 4) -> DataFrame:
    """``a, b, path``: the shortest path that a walk over sorted neighbours finds first, null
    beyond ``max_len`` hops. The graph must be undirected.

    That path is the smallest of the shortest ones. It is made of two halves, each the smallest
    between its end and the vertex where they meet.
    """
    if max_len <= 0:
        raise ValueError("max_len must be positive")
    wanted = stored(pairs.select("a", "b").distinct(), "pairs")
    keyed = stored(graph.numbers(graph.numbers(wanted, "a", "s"), "b", "t").select("s", "t"), "numbered_pairs")
    start = _first_paths(graph, keyed.select("s").distinct(), max_len - max_len // 2, False)
    end = _first_paths(graph, keyed.select(F.col("t").alias("s")).distinct(), max_len // 2, True)
    met = (
        keyed.join(start.select("s", "v", F.col("d").alias("ds"), F.col("path").alias("head")), "s")
        .join(end.select(F.col("s").alias("t"), "v", F.col("d").alias("dt"), F.col("path").alias("tail")), ["t", "v"])
        .groupBy("s", "t")
        .agg(
            F.min(
                F.struct(
                    (F.col("ds") + F.col("dt")).alias("d"),
                    F.concat("head", F.slice("tail", 2, F.size("tail"))).alias("path"),
                )
            ).alias("best")
        )
    )
    return wanted.join(_named(graph, met.select(F.col("best.path").alias("path"))), ["a", "b"], "left")


def all_shortest_paths(
    graph: Graph, pairs: DataFrame, max_len: int, backward: Graph | None = None
) -> DataFrame:
    """``a, b, path``: every shortest path of each pair within ``max_len`` hops.

    Only vertices at the right distance from the far end are stepped on, so no partial
    path is carried that does not arrive. ``backward`` is the reversed graph when the
    graph is directed; it must have the same vertices.
    """
    wanted = stored(pairs.select("a", "b").distinct(), "pairs")
    keyed = stored(graph.numbers(graph.numbers(wanted, "a", "s"), "b", "t").select("s", "t"), "numbered_pairs")
    finished = []
    with Scratch(graph.vertices.sparkSession) as shelf:
        state, _ = _walk(backward or graph, keyed.select(F.col("t").alias("s")).distinct(), shelf, max_len)
        to_end = state.select(F.col("s").alias("t"), "v", F.col("d").alias("left_over"))
        rows = (
            keyed.withColumnRenamed("s", "v")
            .join(to_end, ["t", "v"])
            .join(graph.vertices.select(F.col("no").alias("v"), "slots"), "v")
            .select("t", "v", "slots", "left_over", F.array("v").alias("path"))
        )
        for _hop in range(max_len + 1):
            rows = shelf.keep(rows, "paths")
            finished.append(stored(rows.where("left_over = 0").select("path"), "arrived"))
            moving = rows.where("left_over > 0")
            if moving.isEmpty():
                break
            step = graph.expand(moving.withColumnRenamed("left_over", "before")).select(
                "t", F.col("dst").alias("v"), F.col("dst_slots").alias("slots"), "path", "before"
            )
            rows = (
                step.join(to_end, ["t", "v"])
                .where(F.col("left_over") == F.col("before") - 1)
                .select("t", "v", "slots", "left_over", F.concat("path", F.array("v")).alias("path"))
            )
    return _named(graph, union_all(*finished))


# --- sampling ---------------------------------------------------------------


def even_sample(people: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``size`` rows evenly spaced over the ordered people: places round(i(n-1)/(k-1))."""
    ranked = global_row_number(people, order, "place")
    total = people.count()
    keep = min(total, size)
    if keep <= 0:
        return ranked.where(F.lit(False)).drop("place")
    if keep == total:
        return ranked.drop("place")
    if keep == 1:
        return ranked.where("place = 1").drop("place")
    spark = people.sparkSession
    picked = spark.range(keep).select(
        (F.rint(F.col("id") * (total - 1) / (keep - 1)) + 1).cast("bigint").alias("place")
    )
    return ranked.join(picked.distinct(), "place", "left_semi").drop("place")


def sampled_pairs(graph: Graph, seed: int, size: int) -> DataFrame:
    """``a, b``: ``size`` of all unordered vertex pairs without replacement, seeded.

    Pair numbers are drawn by a keyed permutation and then unranked, so the pairs are never
    listed or sorted.
    """
    n = graph.size
    numbers = draws(graph.vertices.sparkSession, n * (n - 1) // 2, size, seed)
    below = lambda hi: F.call_function("div", hi * (hi - 1), F.lit(2).cast("bigint"))
    near = F.floor((1 + F.sqrt(1 + 8 * F.col("number").cast("double"))) / 2).cast("bigint")
    # Square roots of large numbers may be one off; put the row back in range.
    placed = numbers.withColumn("near", near).select(
        "number",
        (
            F.col("near")
            - (below(F.col("near")) > F.col("number")).cast("bigint")
            + (below(F.col("near") + 1) <= F.col("number")).cast("bigint")
        ).alias("hi"),
    )
    placed = placed.withColumn("lo", F.col("number") - below(F.col("hi")))
    low = graph.vertices.select(F.col("v").alias("a"), (F.col("no") - 1).alias("lo"))
    top = graph.vertices.select(F.col("v").alias("b"), (F.col("no") - 1).alias("hi"))
    return durable(placed.join(low, "lo").join(top, "hi").select("a", "b"))


def betweenness_sampled(graph: Graph, seed: int, size: int, max_len: int = 4) -> DataFrame:
    """``v, tally, score``: how often a vertex lies inside the first shortest path of a pair."""
    paths = first_bridges(graph, sampled_pairs(graph, seed, size), max_len).where("path IS NOT NULL")
    found = F.greatest(paths.select(F.count("*")).scalar(), F.lit(1))
    inside = paths.where("size(path) > 2").select(
        F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("v")
    )
    tally = inside.groupBy("v").agg(F.count("*").alias("tally"))
    return graph.vertices.select("v").join(tally, "v", "left").select(
        "v",
        F.coalesce("tally", F.lit(0)).alias("tally"),
        (F.coalesce("tally", F.lit(0)) / found).alias("score"),
    )


def graph_of_paths(paths: DataFrame, path_count: int) -> tuple[DataFrame, DataFrame]:
    """(arcs, vertices) induced by at most ``path_count`` paths per pair."""
    kept = top_per_group(paths, ["a", "b"], [F.col("path")], path_count)
    steps = kept.where("size(path) > 1").select(
        F.explode(
            F.expr(
                "transform(sequence(1, size(path) - 1), "
                "i -> struct(path[i - 1] AS src, path[i] AS dst))"
            )
        ).alias("x")
    )
    return steps.select("x.src", "x.dst").distinct(), kept.select(F.explode("path").alias("v")).distinct()


# --- components -------------------------------------------------------------


def connected_components(vertices: DataFrame, ties: DataFrame) -> DataFrame:
    """``v, component``: the smallest vertex of each component.

    Alternating star contraction: every round hangs neighbours on a smaller vertex, and
    the number of rounds grows with the logarithm of the component size.
    """
    edges = durable(
        ties.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(floor, "a")
        small = (
            hung.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(floor.withColumnRenamed("m", "b"))
            .where("a <> b")
            .distinct()
        )
        edges = durable(small)
        now = _fingerprint(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return vertices.join(roots, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
    ).first()
    return tuple(row)
