"""Benchmark items found in documents by SimHash windows and multi-index Hamming blocks.

Words are lower-cased runs between white space and ASCII punctuation; shingles are five
words, weighted by their letters. A window's fingerprint has 64 bits, each the weighted
majority of that bit in the window's shingle hashes.

An item is looked for in windows of its size class: at most so long that a passage similar
to the item must hold one of its windows word for word, whatever its few changes are. The
windows of an item start at every word, those of a document at every ``stride``-th, so one
of each meets the other. Fingerprints within ``RADIUS`` bits agree in one of ``RADIUS + 1``
blocks; each block's values are a table, so no fingerprint within the radius is missed. A
hit places the whole item on the document, and its exact weighted-shingle similarity there
(common over joint weight, with multiplicity) decides.

The items' fingerprints go to every task. Their number is bounded by ``ITEM_BYTES`` of item
text a pass: a larger benchmark is worked off in several passes over the documents.

Defined results: null and wordless texts and items match nothing; an item shorter than a
shingle is one shingle; repeated rows are reported alike; a null ``doc_id`` or ``item_id`` is
reported as null; extra columns are ignored by ``hits`` and carried by ``clean``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.llm import words as w

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 3
SIZES = (1, 2, 3, 4, 5, 6, 8, 12, 18, 24)
ITEM_BYTES = 32 << 20
CHUNK = 8192

SEPARATOR = w.IS_SEPARATOR.copy()
SEPARATOR[[c for c in range(128) if not chr(c).isalnum()]] = True


def stride(size: int) -> int:
    return max(1, size // 8)


def size_class(words: int) -> int:
    """The longest window that every passage similar to an item of so many words holds whole.

    A changed word costs five shingles of either side; at this similarity there is one change
    in some thirty words, and the longest run between changes is at least its share.
    """
    if words < SHINGLE:
        return words
    changes = (words - SHINGLE + 1) // 30
    run = (words - changes) // (changes + 1) if changes else int(0.8 * (words - 4)) + 4
    return max(size for size in SIZES if size + stride(size) - 1 <= max(run, SHINGLE))


def _weights(block: w.Words, size: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(block.ends - block.starts)))
    return np.minimum(total[size:] - total[:-size], 255).astype(np.int16)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """SimHash of ``count`` successive shingles from each place on."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    power = np.where(bits == 1, weights[:, None], -weights[:, None]).astype(np.int16)
    places = len(hashes) - count + 1
    total, done, width = None, 0, 1
    # Sums of 1, 2, 4, ... shingles; those in the binary form of ``count`` are strung together.
    while True:
        if count & width:
            part = power[done : done + places]
            total = part.copy() if total is None else total + part
            done += width
        width *= 2
        if width > count:
            break
        half = width // 2
        power = power[:-half] + power[half:]
    return np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Item:
    item_id: object
    words: int
    shingles: Counter  # weight by shingle hash, multiplicity included


@dataclass
class Table:
    """Fingerprints of the item windows of one size, and for each block value where they are."""

    size: int
    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    orders: list[np.ndarray]
    starts: list[np.ndarray]


def _weighted(hashes: np.ndarray, weights: np.ndarray) -> Counter:
    out: Counter = Counter()
    for h, weight in zip(hashes.tolist(), weights.tolist(), strict=True):
        out[h] += weight
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Common over joint weight."""
    common = sum(min(weight, b[h]) for h, weight in a.items() if h in b)
    joint = sum(a.values()) + sum(b.values()) - common
    return common / joint if joint else 0.0


def _block_values(prints: np.ndarray, number: int) -> np.ndarray:
    width = 64 // (RADIUS + 1)
    return ((prints >> np.uint64(number * width)) & np.uint64((1 << width) - 1)).astype(np.int64)


def index(rows: list[tuple[object, str]]) -> tuple[list[Item], list[Table]]:
    """The items, and a table for every window size that one of them takes."""
    items, found = [], {}
    for item_id, text in rows:
        for _, _, block in w.blocks(pa.array([text or ""]), lower=True, separator=SEPARATOR):
            n = len(block.hashes)
            if not n:
                continue
            gram = min(SHINGLE, n)
            hashes, weights = w.shingles(block.hashes, gram), _weights(block, gram)
            items.append(Item(item_id, n, _weighted(hashes, weights)))
            size = size_class(n)
            prints = fingerprints(hashes, weights, size - gram + 1)
            for offset, one in enumerate(prints.tolist()):
                found.setdefault(size, []).append((one, len(items) - 1, offset))
    tables = []
    for size, entries in sorted(found.items()):
        prints = np.array([e[0] for e in entries], dtype=np.uint64)
        orders, starts = [], []
        for number in range(RADIUS + 1):
            value = _block_values(prints, number)
            orders.append(np.argsort(value, kind="stable"))
            starts.append(np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << (64 // (RADIUS + 1)))))))
        tables.append(
            Table(size, prints, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), orders, starts)
        )
    return items, tables


def _near(table: Table, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in ``prints``, table entry) within the radius."""
    out = []
    for number in range(RADIUS + 1):
        value = _block_values(prints, number)
        first, last = table.starts[number][value], table.starts[number][value + 1]
        some = np.flatnonzero(last > first)
        if not len(some):
            continue
        counts = last[some] - first[some]
        place = np.repeat(some, counts)
        before = np.concatenate(([0], np.cumsum(counts)))[:-1]
        entry = table.orders[number][np.arange(len(place)) - np.repeat(before, counts) + np.repeat(first[some], counts)]
        close = np.bitwise_count(prints[place] ^ table.prints[entry]) <= RADIUS
        out.append(np.stack([place[close], entry[close]]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(out, axis=1), axis=1)
    return both[0], both[1]


def find(texts: pa.Array, items: list[Item], tables: list[Table], least: float):
    """``(row, item, start, words, similarity)``, the best place of each item in each text."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for begin, _, block in w.blocks(texts, lower=True, separator=SEPARATOR):
        tried = set()
        for table in tables:
            gram = min(SHINGLE, table.size)
            count = table.size - gram + 1
            hashes, weights = w.shingles(block.hashes, gram), None
            if len(hashes) < count:
                continue
            weights = _weights(block, gram)
            starts, owner = w.within(block.first, table.size)
            step = stride(table.size)
            if step > 1:
                every = (starts - block.first[owner]) % step == 0
                starts, owner = starts[every], owner[every]
            for at in range(0, len(block.hashes), CHUNK):
                a, b = np.searchsorted(starts, [at, at + CHUNK])
                if a == b:
                    continue
                prints = fingerprints(
                    hashes[at : at + CHUNK + count - 1], weights[at : at + CHUNK + count - 1], count
                )[starts[a:b] - at]
                for place, entry in zip(*_near(table, prints), strict=True):
                    i = int(owner[a + place])
                    begin_at = int(starts[a + place]) - int(table.offsets[entry])
                    tried.add((i, int(table.items[entry]), begin_at))
        for i, number, start in sorted(tried):
            item = items[number]
            lo, hi = int(block.first[i]), int(block.first[i + 1])
            lo_at, hi_at = max(start, lo), min(start + item.words, hi)
            gram = min(SHINGLE, item.words)
            if hi_at - lo_at < gram:
                continue
            own = w.shingles(block.hashes[lo_at:hi_at], gram)
            lengths = np.concatenate(([0], np.cumsum(block.ends[lo_at:hi_at] - block.starts[lo_at:hi_at])))
            weights = np.minimum(lengths[gram:] - lengths[:-gram], 255)
            alike = similarity(item.shingles, _weighted(own, weights))
            key = (begin + i, number)
            if alike >= least and (key not in best or alike > best[key][0]):
                best[key] = (alike, lo_at - lo, hi_at - lo_at)
    return [(row, number, start, n, alike) for (row, number), (alike, start, n) in sorted(best.items())]


def _passes(benchmark: DataFrame, item_bytes: int):
    """The items in parts of a bounded size, each with its tables."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    for part in range(parts):
        chosen = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield index([(row["item_id"], row["text"]) for row in chosen.collect()])


def hits(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity`` of every item found in a document."""
    kinds = [f.dataType for f in (docs.schema["doc_id"], benchmark.schema["item_id"])]
    schema = (
        f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, "
        "start_word bigint, n_words bigint, similarity double"
    )
    out = None
    for known in _passes(benchmark, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            items, tables = shared.value
            for batch in batches:
                found = find(batch.column("text"), items, tables, least)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array([f[0] for f in found])),
                            pa.array([items[f[1]].item_id for f in found]),
                            pa.array([f[2] for f in found], pa.int64()),
                            pa.array([f[3] for f in found], pa.int64()),
                            pa.array([f[4] for f in found], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    out = docs
    for known in _passes(benchmark, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            items, tables = shared.value
            for batch in batches:
                kept = np.ones(batch.num_rows, dtype=bool)
                kept[[f[0] for f in find(batch.column("text"), items, tables, least)]] = False
                yield batch.filter(pa.array(kept))

        out = out.mapInArrow(run, docs.schema)
    return out
