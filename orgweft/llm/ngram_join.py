"""Exact Jaccard join of documents on word n-grams, reduced to link components.

Two documents link when their shingle sets' Jaccard similarity reaches a threshold. The
join loses no link between different sets, and never lists the pairs of a group:

1. Documents with equal sets form classes; only one set per class goes on.
2. Sizes fall into bands, and a pair belongs to the band of its larger set. Two sets that link
   differ in at most ``D`` shingles, which follows from their sizes. Each set is dealt, by hash, into
   half as many parts again; at most ``D`` of its filled parts then differ from the partner's, and
   the hash of a part's whole content is a key that all others share. A set with no more than
   ``D`` filled parts (only two such sets can miss each other) adds prefix keys: the shingles of
   smallest hash, one more than it may lack in common.
3. In the order of how many sets hold a key, the first ``D + 1`` keys of either set hold one of
   both, so only those count. A set that shares a passage, or phrases that many documents have,
   has more than ``D`` keys of its own and drops out here, whatever it shares.
   Keys are counted first; a filter of the shared ones, of bounded size, then keeps most keys of one
   set only out of the shuffle that brings the counts to the sets (what it lets through by mistake
   falls out in the join).
   Each remaining key ties its sets to the smallest of them (a star, not all pairs); the
   components of these ties are candidate clusters, so each set is sent once.
4. A cluster is a tile. Clusters that exceed ``TILE_SHINGLES`` are cut into bands of set size
   (a link bridges neighbouring bands at most) and into blocks, with a tile per pair of
   blocks, so that no task holds more than a few blocks.
5. In a tile, sets are compared by size order. Bitmaps of hashed shingles bound the overlap
   from above: each bit that one set has alone is an element the other lacks. Pairs whose
   bound suffices are counted exactly on sorted arrays, unless links found before already
   join them.

Defined results: null or wordless texts have no shingles and link with nothing; a text
shorter than a shingle is one shingle of its whole word sequence, and a very long one is a set
like others; a null ``doc_id`` links with nothing and is its own (null) component; repeated rows
share their component. Extra columns are ignored by ``components`` and carried by
``representatives``, whatever their names. If rows share an id, ``representatives`` keeps the one
whose values have the smallest hash; equal rows are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.llm import words as w
from orgweft.operators.graph import connected_components
from orgweft.llm.stages import stored, temporary

BAND_RATIO = 1.6
#: A bitmap has twice as many bits as the tile's mean set has shingles, 1024 at least; narrower ones
#: would be full for large sets and bound nothing.
LEAST_BITS = 1024
TILE_SHINGLES = 12_000_000
PIVOTS = 6
#: Bits of the filter of shared keys (8 MB); with more keys it lets more through.
FILTER_BITS = 1 << 26
#: Parts to a set for each shingle that a partner may have different.
PARTS = 1.5


def _sets(texts: pa.Array, size: int):
    """Sorted distinct shingle hashes of each text."""
    for start, stop, block in w.blocks(texts, lower=True):
        grams = w.shingles(block.hashes, size)
        for i in range(stop - start):
            first, last = block.first[i], block.first[i + 1]
            if last - first >= size:
                yield np.unique(grams[first : last - size + 1])
            elif last > first:
                yield w.shingles(block.hashes[first:last], int(last - first))
            else:
                yield np.empty(0, dtype=np.uint64)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def pair_needed(a, b, percent: int):
    """The least overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def _digests(size: int):
    def run(batches):
        for batch in batches:
            n, one, two = [], [], []
            for own in _sets(batch.column("text"), size):
                n.append(len(own))
                one.append(int(_digest(own)))
                two.append(int(np.bitwise_xor.reduce(w.mix(own))) if len(own) else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(w.signed(np.array(one, np.uint64))),
                    pa.array(w.signed(np.array(two, np.uint64))),
                ],
                names=["doc_id", "n", "d1", "d2"],
            )

    return run


def bands(percent: int, largest: int) -> np.ndarray:
    """The largest size of each band, up to the band above the one that holds ``largest``. Sets
    that link lie in one band or in neighbouring ones.
    """
    ratio, tops = max(BAND_RATIO, 100 / percent), []
    while len(tops) < 2 or tops[-2] < largest:
        low = tops[-1] + 1 if tops else 1
        tops.append(max(low, int(low * ratio)))
    return np.array(tops, dtype=np.int64)


def keys(own: np.ndarray, band: int, top: int, percent: int) -> np.ndarray:
    """Keys of a set in a band whose largest size is ``top``."""
    return keys_and_room(own, band, top, percent)[0]


def keys_and_room(own: np.ndarray, band: int, top: int, percent: int) -> tuple[np.ndarray, int]:
    """Keys of a set in a band whose largest size is ``top``, and how many more keys than it has
    it would need to be sure of a shared one: with 0 or less, so many of its keys can be left out.
    """
    least = 2 * top * (100 - percent) // (100 + percent)
    parts = int(least * PARTS) + 1
    part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    content = np.add.reduceat(w.mix(own + np.uint64(1)), begins)
    out = w.mix(content + part[begins] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
    differ = (len(own) + min(top, 100 * len(own) // percent)) * (100 - percent) // (100 + percent)
    room = differ + 1 - len(begins)
    if room > 0:
        prefix = own[: len(own) - needed(len(own), percent) + 1]
        out = np.concatenate([out, w.mix(prefix ^ np.uint64((band + 1) << 40))])
    return out, room


def _digest(own: np.ndarray) -> np.uint64:
    return w.mix(own + np.uint64(len(own))).sum(dtype=np.uint64)


def key_filter(shared: DataFrame) -> np.ndarray:
    """A bit for each remainder that a key ``h`` of the frame has, as bytes."""
    at = F.pmod("h", F.lit(FILTER_BITS))
    parts = (
        shared.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    # Bucket n holds the places from 32768 * (n - 1) + 1 to 32768 * n.
    out = np.zeros(FILTER_BITS // 8 + 4096, dtype=np.uint8)
    for row in parts.collect():
        begin = 4096 * row["part"]
        out[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _passing(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which keys a filter lets through."""
    at = w.signed(found) % FILTER_BITS
    # Place p > 0 is bit (p - 1) % 32768 of bucket (p - 1) // 32768 + 1; place 0 is bit 0 of bucket 0.
    place = np.where(at > 0, at - 1 + 32768, 0)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _keyed(size: int, percent: int, shared=None):
    """Keys of each text, all of them or those that the broadcast filter ``shared`` lets through."""

    def run(batches):
        for batch in batches:
            sets = [own for own in _sets(batch.column("text"), size) if len(own)]
            if not sets:
                continue
            tops = bands(percent, max(map(len, sets)))
            found, nodes, at, rooms, counts = [], [], [], [], []
            for own in sets:
                band = int(np.searchsorted(tops, len(own)))
                both = 100 * len(own) // percent > tops[band]
                for place in (band, band + 1) if both else (band,):
                    own_keys, room = keys_and_room(own, place, int(tops[place]), percent)
                    if shared is not None:
                        own_keys = own_keys[_passing(shared.value, own_keys)]
                    found.append(own_keys)
                    nodes.append(_digest(own))
                    at.append(place)
                    rooms.append(room)
                    counts.append(len(own_keys))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(w.signed(np.concatenate(found))),
                    pa.array(np.repeat(w.signed(np.array(nodes, np.uint64)), counts)),
                    pa.array(np.repeat(np.array(at, np.int32), counts)),
                    pa.array(np.repeat(np.array(rooms, np.int64), counts)),
                ],
                names=["h", "d1", "band", "room"],
            )

    return run


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap per set, all of one width."""
    mean = sum(map(len, sets)) // max(1, len(sets))
    width = max(LEAST_BITS, 1 << (2 * mean).bit_length())
    out = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for i, own in enumerate(sets):
        bits = np.zeros(width, dtype=bool)
        bits[(own % np.uint64(width)).astype(np.int64)] = True
        out[i] = np.packbits(bits).view(np.uint64)
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[place] == a))


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what linked sets of a tile join: a forest, at most one per set."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    sets, nodes = [sets[i] for i in order], [int(nodes[i]) for i in order]
    sizes = np.array([len(own) for own in sets], dtype=np.int64)
    bitmaps = _signatures(sets)
    root = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    pivots: list[int] = []  # sets that others linked with lately
    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes[:i], needed(int(sizes[i]), percent)))
        if low == i:
            continue
        joined: set[int] = set()
        partners: list[int] = []
        for j in pivots:
            if j >= low and root[j] not in joined:
                if _overlap(sets[i], sets[j]) >= pair_needed(int(sizes[i]), int(sizes[j]), percent):
                    joined.add(int(root[j]))
                    partners.append(j)
                    break
        # Only sets of other components can still add a link.
        rest = low + np.flatnonzero(root[low:i] != next(iter(joined), -1))
        if len(rest):
            alone = np.bitwise_count(bitmaps[i] & ~bitmaps[rest]).sum(axis=1, dtype=np.int64)
            other = np.bitwise_count(bitmaps[rest] & ~bitmaps[i]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(sizes[i] - alone, sizes[rest] - other)
            least = pair_needed(sizes[i], sizes[rest], percent)
            possible = np.flatnonzero(bound >= least)
            possible = possible[np.argsort(-(bound[possible] - least[possible]), kind="stable")]
            for k in possible:
                j = int(rest[k])
                if int(root[j]) in joined:
                    continue
                if _overlap(sets[i], sets[j]) >= least[k]:
                    joined.add(int(root[j]))
                    partners.append(j)
        if joined:
            out += [(nodes[j], nodes[i]) for j in partners]
            pivots = ([*partners, *[j for j in pivots if j not in partners]])[:PIVOTS]
            keep = min(joined)
            root[i] = keep
            if len(joined) > 1:
                root[:i][np.isin(root[:i], list(joined))] = keep
    return out


def _linker(size: int, percent: int):
    """Links of a tile. Its texts come as text, which takes less room on the way than sets."""

    def run(table: pa.Table) -> pa.Table:
        sets = [own for part in table.column("text").chunks for own in _sets(part, size)]
        links = tile_links(table.column("node").to_numpy(), sets, percent)
        return pa.table(
            {
                "a": pa.array([a for a, _ in links], pa.int64()),
                "b": pa.array([b for _, b in links], pa.int64()),
            }
        )

    return run


def _tiles(members: DataFrame, percent: int, tile_shingles: int) -> DataFrame:
    """``node, tiles``: the tiles that each member of a candidate cluster goes to."""
    tops = F.array(*[F.lit(int(top)) for top in bands(percent, 1 << 40)]).cast("array<bigint>")
    band = F.size(F.filter(tops, lambda top: top < F.col("n"))).cast("bigint")
    weights = members.groupBy("cluster").agg(F.sum("n").alias("weight"), F.count("*").alias("size"))
    weights = weights.where("size > 1")
    placed = members.join(stored(weights, "clusters"), "cluster")
    small = placed.where(F.col("weight") <= tile_shingles).select(
        "node", F.struct("cluster", *[F.lit(0).cast("bigint").alias(c) for c in ("band", "i", "j")]).alias("tile")
    )
    # A set goes to its band and, if a larger partner may lie there, to the next.
    reach = F.floor(F.col("n") * 100 / percent) > F.get(tops, F.col("band").cast("int"))
    large = (
        placed.where(F.col("weight") > tile_shingles)
        .withColumn("band", band)
        .withColumn("band", F.explode(F.when(reach, F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array("band"))))
        .select("cluster", "node", "n", "band")
    )
    load = large.groupBy("cluster", "band").agg(
        F.ceil(F.sum("n") / F.lit(tile_shingles)).alias("blocks")
    )
    large = large.join(stored(load, "bands"), ["cluster", "band"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    large = (
        large.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(
            "node",
            F.struct(
                "cluster", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
            ).alias("tile"),
        )
    )
    return small.union(large).groupBy("node").agg(F.collect_list("tile").alias("tiles"))


def _ties(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: the smallest set of each key that counts, and the others that hold it."""
    keyed = lambda shared=None: texts.select("text").mapInArrow(
        _keyed(size, percent, shared), "h bigint, d1 bigint, band int, room bigint"
    )
    shared = stored(
        keyed().groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1"), "keys"
    )
    known = texts.sparkSession.sparkContext.broadcast(key_filter(shared))
    # Keys of one set only come first in the order, so they take up the first places.
    first = (
        keyed(known)
        .join(shared.hint("shuffle_hash"), "h")  # a key has one row there, and most keys have none
        .groupBy("d1", "band", "room")
        .agg(F.sort_array(F.collect_set(F.struct("sets", "h"))).alias("own"))
        .withColumn("places", F.size("own") + F.least("room", F.lit(0)))
        .where("places > 0")
    )
    counting = stored(
        first.select("d1", F.explode(F.slice("own", F.lit(1), F.col("places").cast("int"))).alias("key")).select(
            "d1", F.col("key.h").alias("h")
        ),
        "counting",
    )
    smallest = counting.groupBy("h").agg(F.min("d1").alias("first"), F.max("d1").alias("last"))
    return (
        counting.join(smallest.where("first < last").drop("last"), "h")
        .where("d1 <> first")
        .select(F.col("first").alias("a"), F.col("d1").alias("b"))
        .distinct()
    )


def components(
    docs: DataFrame, size: int = 5, percent: int = 80, tile_shingles: int = TILE_SHINGLES
) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` per row. ``component_id`` is the smallest
    ``doc_id`` reachable over links, ``class_id`` the smallest with an equal set.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    digests = stored(
        rows.mapInArrow(_digests(size), "doc_id bigint, n bigint, d1 bigint, d2 bigint"), "digests"
    )
    classes = stored(
        digests.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("node")),
        "classes",
    )
    # One document of each class; the merge is the plan at every size, as classes grow with the corpus.
    only = classes.select(F.col("node").alias("doc_id")).distinct()
    with temporary(rows.join(only.hint("merge"), "doc_id", "left_semi"), "class_texts") as known:
        ties = stored(_ties(known, size, percent), "ties")
        tied = ties.select(F.col("a").alias("v")).union(ties.select("b")).distinct()
        clusters = stored(connected_components(stored(tied, "tied"), ties), "candidates")
        members = clusters.select(F.col("v").alias("d1"), F.col("component").alias("cluster")).join(
            classes.select("d1", "node", "n"), "d1"
        )
        tiles = stored(_tiles(members, percent, tile_shingles), "tiles")
        # One plan at every size: the tiles grow with the corpus, so they are never broadcast.
        members = known.join(tiles.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id").select(
            F.explode("tiles").alias("tile"), F.col("doc_id").alias("node"), "text"
        )
        links = stored(
            members.groupBy("tile").applyInArrow(_linker(size, percent), "a bigint, b bigint"), "links"
        ).distinct()
    linked = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
    joined = stored(connected_components(stored(linked, "linked"), stored(links, "forest")), "components")
    named = stored(
        classes.join(joined, F.col("node") == F.col("v"), "left").select(
            "d1", "d2", "n", "node", F.coalesce("component", "node").alias("component")
        ),
        "named",
    )
    return digests.join(named, ["d1", "d2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("class_id"),
    )


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one row of each, with all columns.

    Rows without a ``doc_id`` stay, as they belong to no component. Ids and hashes of whole rows
    decide which row stays, so the rows themselves are shuffled once.
    """
    names = [F.col(f"`{name}`") for name in docs.columns]
    # Nulls do not count in the hash of several columns, so their places are hashed as well.
    mark = F.xxhash64(*names, *[name.isNull() for name in names])
    wrapped = docs.select(F.col("doc_id").cast("bigint").alias("id"), mark.alias("mark"), F.struct(*names).alias("row"))
    least = docs.select(F.col("doc_id").cast("bigint").alias("id"), mark.alias("mark")).groupBy("id").agg(
        F.min("mark").alias("mark")
    )
    first = components(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias("id"))
    kept = stored(least.join(first, "id", "left_semi"), "kept")
    chosen = wrapped.join(kept, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return chosen.union(wrapped.where("id IS NULL")).select("row.*")


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2),
         lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r AS (SELECT doc_id AS a, doc_id AS b FROM n
    UNION SELECT r.a, arcs.b FROM r JOIN arcs ON arcs.a = r.b)
  SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component AS component_id
FROM n JOIN reach ON a = doc_id"""
