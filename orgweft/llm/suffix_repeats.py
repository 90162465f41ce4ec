"""Repeated word sequences found in suffix trees that are partitioned by prefix.

A word sequence of ``min_words`` that starts in several documents is an internal node of
the corpus's suffix tree at that depth or deeper. The tree is never built as a whole:

1. Every window of ``min_words`` words has an anchor, the five-word gram of the smallest
   hash in it. Equal windows have equal anchors, so a window whose anchor occurs in one
   document only is a leaf by itself. Only some two ninths of all places are anchors.
2. Suffixes that may share a node go to a subtree by a prefix of theirs. A prefix that starts
   more suffixes than fit is lengthened (one, two, four, eight words), until the group is small.
   Which prefixes are that frequent is measured over the whole corpus beforehand.
3. A subtree's suffixes are sorted by their label down to the wanted depth: runs of equal
   labels are its deep nodes. Every leaf of a node but those of its smallest document is a
   repeat; overlapping leaves join into maximal spans.
4. A prefix that is still too frequent at full depth is a single node with very many leaves.
   It needs no sorting: its smallest document is an aggregate, and its leaves look that up.

Defined results: a null text has no words; texts shorter than a window keep all; a sequence
that one document repeats within itself stays; a null ``doc_id`` counts as larger than all
others; rows that repeat a ``doc_id`` do not judge each other. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orgweft.llm import words as w
from orgweft.llm.stages import stored

MIN_WORDS = 13
GRAM = 5
PREFIXES = (1, 2, 4, 8)
GROUPS_PER_PARTITION = 8
LAST = (1 << 63) - 1


def _anchors(block: w.Words, min_words: int):
    """Window starts, their texts and the word position of their anchors; and all gram hashes."""
    size = min(GRAM, min_words)
    grams = w.shingles(block.hashes, size)
    count = len(block.hashes) - min_words + 1
    if count <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, grams
    best = grams[:count].copy()
    place = np.zeros(count, dtype=np.int64)
    for step in range(1, min_words - size + 1):
        other = grams[step : step + count]
        better = other < best
        best[better] = other[better]
        place[better] = step
    starts, owner = w.within(block.first, min_words)
    return starts, owner, starts + place[starts], grams


def _anchor_rows(min_words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("_id").to_numpy()
            tags = batch.column("_tag").to_numpy()
            for start, _, block in w.blocks(batch.column("text"), lower=False):
                _, owner, anchors, grams = _anchors(block, min_words)
                if not len(anchors):
                    continue
                new = np.concatenate(([True], np.diff(anchors) != 0))
                anchors, owner = anchors[new], owner[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.signed(grams[anchors])),
                        pa.array(ids[start + owner]),
                        pa.array((tags[start + owner] << 40) | (anchors - block.first[owner])),
                    ],
                    names=["h", "_id", "at"],
                )

    return run


def _frequent_prefixes(min_words: int, groups: int):
    """Prefixes that start at least one in ``groups`` windows of a block, with their numbers.

    A block is some two million bytes of texts, so a task holds few hashes at a time.
    """

    def run(batches):
        for batch in batches:
            for _, _, block in w.blocks(batch.column("text"), lower=False):
                starts, _ = w.within(block.first, min_words)
                if not len(starts):
                    continue
                for size in (*(p for p in PREFIXES if p < min_words), min_words):
                    value, count = np.unique(w.shingles(block.hashes, size)[starts], return_counts=True)
                    often = count * groups >= len(starts)
                    n = int(often.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n + 1, size, np.int32)),
                            pa.array(np.append(w.signed(value[often]), 0)),
                            pa.array(np.append(count[often], len(starts)).astype(np.int64)),
                            pa.array(np.arange(n + 1) == n),
                        ],
                        names=["size", "h", "n", "total"],
                    )

    return run


def _frequent(rows: DataFrame, min_words: int, groups: int) -> dict[int, np.ndarray]:
    """By length, the prefixes that are too frequent for one group: at most ``4 * groups`` of
    each. One that exceeds its share in the corpus does so in some block, so none is missed.
    """
    counts = (
        rows.mapInArrow(_frequent_prefixes(min_words, groups), "size int, h bigint, n bigint, total boolean")
        .groupBy("size", "total", "h")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.where("total").select(F.col("size").alias("_size"), F.col("n").alias("windows"))
    kept = (
        counts.where("NOT total")
        .join(totals, F.col("size") == F.col("_size"))
        .where(F.col("n") * (4 * groups) >= F.col("windows"))
        .select("size", "h")
        .toArrow()
    )
    sizes, hashes = kept.column("size").to_numpy(), kept.column("h").to_numpy()
    return {
        size: np.sort(hashes[sizes == size].view(np.uint64)) for size in (*PREFIXES, min_words)
    }


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _suffixes(min_words: int, frequent):
    """Suffixes at windows whose anchor is marked: group, label, document and place."""

    def run(batches):
        for batch in batches:
            ids = batch.column("_id").to_numpy()
            tags = batch.column("_tag").to_numpy()
            marks = batch.column("marks")
            for start, stop, block in w.blocks(batch.column("text"), lower=False):
                starts, owner, anchors, _ = _anchors(block, min_words)
                marked = np.zeros(len(block.hashes) + 1, dtype=bool)
                for i in range(start, stop):
                    marked[block.first[i - start] + marks[i].values.to_numpy()] = True
                chosen = marked[anchors]
                starts, owner = starts[chosen], owner[chosen]
                if not len(starts):
                    continue
                label = w.shingles(block.hashes, min_words)[starts]
                group = np.zeros(len(starts), dtype=np.uint64)
                open_ = np.ones(len(starts), dtype=bool)
                for size in PREFIXES:
                    if size >= min_words or not open_.any():
                        break
                    prefix = w.shingles(block.hashes, size)[starts]
                    closing = open_ & ~_member(prefix, frequent[size])
                    group[closing] = w.mix(prefix[closing] + np.uint64(size))
                    open_ &= ~closing
                single = _member(label, frequent[min_words]) & open_
                group[open_] = label[open_]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.signed(group)),
                        pa.array(w.signed(label)),
                        pa.array(ids[start + owner]),
                        pa.array((tags[start + owner] << 40) | (starts - block.first[owner])),
                        pa.array(single),
                    ],
                    names=["prefix", "label", "_id", "at", "single"],
                )

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_id, _tag, starts``: per document, the starts of the windows that a document of a
    smaller id also holds.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*_identity(), F.coalesce("text", F.lit("")).alias("text"))
    anchors = lambda: rows.mapInArrow(_anchor_rows(min_words), "h bigint, _id bigint, at bigint")
    shared = stored(
        anchors()
        .groupBy("h")
        .agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
        .where("lo < hi")
        .select("h"),
        "anchors",
    )
    marks = stored(
        _by_document(anchors().join(shared, "h"), "marks"),
        "marks",
    )
    frequent = _frequent(rows, min_words, GROUPS_PER_PARTITION * parts)
    leaves = rows.join(marks, ["_id", "_tag"]).mapInArrow(
        _suffixes(min_words, frequent),
        "prefix bigint, label bigint, _id bigint, at bigint, single boolean",
    )
    if len(frequent[min_words]):
        leaves = stored(leaves, "leaves")
    node = W.partitionBy("prefix", "label")
    found = (
        leaves.where("NOT single")
        .select("prefix", "label", "_id", "at")
        .repartition(parts, "prefix")
        .withColumn("least", F.min("_id").over(node))
        .where("_id > least")
        .select("_id", "at")
    )
    if len(frequent[min_words]):
        large = leaves.where("single")
        least = stored(large.groupBy("label").agg(F.min("_id").alias("least")), "nodes")
        found = found.union(large.join(least, "label").where("_id > least").select("_id", "at"))
    return stored(_by_document(stored(found, "repeats"), "starts"), "starts")


def _identity() -> list:
    """Id and a short mark of the text; both together tell rows apart that share an id."""
    return [
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_id"),
        F.expr("xxhash64(text) & 8388607L").alias("_tag"),
    ]


def _by_document(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy("_id", F.shiftright("at", 40).alias("_tag")).agg(
        F.collect_set(F.expr("at & 1099511627775L")).alias(name)
    )


def _remover(min_words: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                own = text.as_py().encode("utf-8", "replace").split()
                n_words.append(len(own))
                if not starts.is_valid:
                    n_removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(own))
                    continue
                at = starts.values.to_numpy()
                change = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + min_words, -1)
                covered = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
                spans.append(
                    [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                )
                n_removed.append(int(covered.sum()))
                kept.append(b" ".join(compress(own, ~covered)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept``: per row, the maximal repeated spans (words,
    end exclusive) and the words outside them, joined by one space.
    """
    found = repeats(docs, min_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *_identity(), F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.join(found, ["_id", "_tag"], "left")
        .select("doc_id", "text", "starts")
        .mapInArrow(
            _remover(min_words),
            f"doc_id {kind}, n_words bigint, n_removed bigint, "
            "spans array<struct<start:bigint,end:bigint>>, kept string",
        )
    )


SQL = """
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM s),
c AS (
  SELECT DISTINCT doc_id, i + more AS i
  FROM (SELECT doc_id, i, unnest(range(0, 13)) AS more FROM m WHERE least < doc_id)),
r AS (SELECT doc_id, list(i) AS removed, count(*) AS n FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(removed, i), false)), ' '))
         AS kept_sha256
FROM t LEFT JOIN r ON r.doc_id = t.doc_id"""
