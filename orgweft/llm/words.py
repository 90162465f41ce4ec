"""Words of whole texts as 64-bit hashes, found for a batch of texts at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Batches arrive as Arrow string arrays; their UTF-8 buffer is cut into
words with a handful of vector operations, so no Python code runs per word.

A word's hash is its polynomial value modulo 2**64 under a fixed odd base, taken from
prefix sums, then mixed together with its length. Equal words have equal hashes on every
machine; different words share one with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 21

IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``length`` or more of them."""
    if not _powers or next(iter(_powers)) < length:
        size = max(_BLOCK, 1 << (length - 1).bit_length())
        tables = []
        for factor in (_BASE, _INVERSE):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return next(iter(_powers.values()))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a block of texts; text ``i`` holds ``first[i]:first[i + 1]`` of them."""

    buffer: np.ndarray  # bytes of all texts of the block, lower-cased if asked for
    hashes: np.ndarray  # uint64 per word
    starts: np.ndarray  # byte positions in the buffer
    ends: np.ndarray
    first: np.ndarray  # word offsets of the texts, one more than texts

    def owner(self) -> np.ndarray:
        """The text (position in the block) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and their offsets; null gives none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(ends) or ends[-1] == ends[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def blocks(texts: pa.Array, lower: bool, separator: np.ndarray = IS_SEPARATOR):
    """``(from, to, Words)`` over runs of texts of some two million bytes (one at least).

    ``separator`` tells for each byte whether it parts words.
    """
    data, offsets = _buffer(texts)
    start, count = 0, len(offsets) - 1
    while start < count:
        stop = int(np.searchsorted(offsets, offsets[start] + _BLOCK, side="right")) - 1
        stop = min(max(stop, start + 1), count)
        part = data[offsets[start] : offsets[stop]]
        yield start, stop, _cut(part, offsets[start : stop + 1] - offsets[start], lower, separator)
        start = stop


def _cut(part: np.ndarray, offsets: np.ndarray, lower: bool, table: np.ndarray) -> Words:
    if lower:
        part = LOWER[part]
    length = len(part)
    # A text's end also ends its last word: word starts are looked for per text.
    separator = np.ones(length + 1, dtype=bool)
    separator[1:] = table[part]
    begins = separator[:-1].copy()
    begins[offsets[:-1][offsets[:-1] < length]] = True
    begins &= ~separator[1:]
    starts = np.flatnonzero(begins)
    stops = np.ones(length, dtype=bool)
    stops[:-1] = separator[2:]
    inner = offsets[1:]
    stops[inner[inner > 0] - 1] = True
    stops &= ~separator[1:]
    ends = np.flatnonzero(stops) + 1
    power, inverse = _power_tables(length + 1)
    sums = np.zeros(length + 1, dtype=np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:length], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    value ^= (ends - starts).astype(np.uint64) << np.uint64(56)
    return Words(part, mix(value), starts, ends, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; the last ``size - 1`` are missing."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    value = np.zeros(count, dtype=np.uint64)
    for place in range(size):
        value *= np.uint64(_BASE)
        value += hashes[place : place + count]
    return mix(value)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Word positions from which ``size`` words lie in one text, and their text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(counts.sum()) - before[owner] + first[:-1][owner], owner


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, as Spark's long has them."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
