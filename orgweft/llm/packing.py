"""Documents packed into sequences of a fixed number of tokens.

Documents become token ids, and ids become pieces of at most the capacity. What the packing
needs to know of millions of pieces is how many there are of each length: one histogram
with as many entries as the capacity has tokens. On it a configuration linear program is
solved: choose how many sequences follow each configuration (a multiset of lengths within
the capacity) so that all lengths are covered by few sequences. Multiplicative weights
price the lengths, a knapsack dynamic program over the capacity finds the configurations
that are worth most at these prices, and weights fall as lengths get covered. The solution
is rounded down; what is left is packed by best fit, again on counts. The pieces then look
up their places by their rank among those of their length, which a range sort gives.

The driver holds the histogram and the configurations, whose number depends on the
capacity and the rounds, not on the documents.

Defined results: a null or empty text is one piece that holds the end id alone. Longer
documents, however long, are cut from the end, so that the first piece is the short one.
Repeated rows and null ``doc_id`` are packed like others; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.functions.ranking import global_row_number
from orgweft.llm.stages import stored

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"
ROUNDS = 48
SLACK = 0.02
STRENGTH = 4.0

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """``text -> uint32 ids`` of a vocabulary: the name of a public one, or a file's path.

    ``.json`` files are read by ``tokenizers`` as they are. A public name uses the rank file of
    the same vocabulary, which gives the same ids in a fraction of the time; the special strings
    that its JSON file names are found in texts and get their ids, as that library does.
    """
    if vocabulary not in _encoders:
        if vocabulary.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(vocabulary)
            _encoders[vocabulary] = lambda text: np.array(
                own.encode(text, add_special_tokens=False).ids, dtype=np.uint32
            )
        else:
            import public_tokenizers
            import tiktoken

            path, special = vocabulary, {}
            if not path.endswith(".tiktoken"):
                path = public_tokenizers.path(f"{vocabulary}.tiktoken")
                with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
                    special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding(
                "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
            )
            _encoders[vocabulary] = lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    return _encoders[vocabulary]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _cutter(vocabulary: str, capacity: int, keep_ids: bool):
    def pieces(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for number, (at, size) in enumerate(cut(len(own), capacity)):
                    data = own[at : at + size].tobytes()
                    rows.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data))
                    if keep_ids:
                        ids.append(data)
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces


def pieces(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian
    32-bit numbers) of every piece; written once, as tokenizing is the dear step.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return stored(
        docs.select("doc_id", "text").mapInArrow(
            _cutter(vocabulary, capacity, keep_ids), schema + (", ids binary" if keep_ids else "")
        ),
        "pieces",
    )


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each room of 0 to ``capacity`` tokens, and the length added last (0:
    none, the room is the next smaller one's).
    """
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        upto = np.searchsorted(lengths, room, side="right")
        values = best[room - lengths[:upto]] + prices[:upto]
        top = int(values.argmax())
        if values[top] > best[room - 1]:
            best[room], last[room] = values[top], lengths[top]
        else:
            best[room] = best[room - 1]
    return best, last


def _filled(room: int, last: np.ndarray) -> Counter:
    out: Counter = Counter()
    while room > 0:
        if last[room]:
            out[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return out


def solve(
    histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS
) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ``((length, times), ...)`` and how many sequences follow each; together
    they hold every piece once.
    """
    left = Counter({length: n for length, n in histogram.items() if n > 0})
    plan: Counter = Counter()
    full = left.pop(capacity, 0)
    if full:
        plan[((capacity, 1),)] = full
    if left:
        for configuration, times in _covered(left, capacity, rounds).items():
            plan[configuration] += times
            for length, n in configuration:
                left[length] -= n * times
        _best_fit(left, capacity, plan)
    return sorted(plan.items(), reverse=True)


def _covered(demand: Counter, capacity: int, rounds: int) -> Counter:
    """The linear program's solution, rounded down: no length is covered beyond its demand."""
    lengths = np.array(sorted(demand), dtype=np.int64)
    needed = np.array([demand[int(length)] for length in lengths], dtype=float)
    index = {int(length): i for i, length in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    share: dict[tuple, float] = {}
    for _ in range(rounds):
        # A length's price grows with its tokens and falls as it gets covered.
        prices = lengths * np.exp(-STRENGTH * covered)
        best, last = _knapsack(prices, lengths, capacity)
        worth = prices + best[capacity - lengths]
        chosen = set()
        for i in np.flatnonzero(worth >= (1 - SLACK) * best[capacity]):
            one = _filled(capacity - int(lengths[i]), last)
            one[int(lengths[i])] += 1
            chosen.add(tuple(sorted(one.items(), reverse=True)))
        used = np.zeros(len(lengths))
        weight = {}
        for one in chosen:
            # As many as the scarcest of its lengths allows on its own.
            weight[one] = min(needed[index[length]] / n for length, n in one)
            for length, n in one:
                used[index[length]] += weight[one] * n
        step = 1 / (used / needed).max()
        # Every round adds its part of the demand at most, and never more than what is left.
        fits = np.min(np.where(used > 0, (1 - covered) * needed / np.maximum(used, 1e-300), np.inf))
        step = min(step * 4 / rounds, fits)
        if step <= 0:
            break
        for one, n in weight.items():
            share[one] = share.get(one, 0.0) + n * step
        covered += used * step / needed
    return Counter({one: int(n) for one, n in share.items() if n >= 1})


def _best_fit(left: Counter, capacity: int, plan: Counter) -> None:
    """Longest first, filled up with the longest that fit; the same filling is used again as
    long as the counts allow, so the steps depend on the lengths and not on the pieces.
    """
    lengths = np.array(sorted(length for length, n in left.items() if n > 0), dtype=np.int64)
    counts = np.array([left[int(length)] for length in lengths], dtype=np.int64)
    while len(lengths):
        one: dict[int, int] = {}
        room, top = capacity, len(lengths)
        while top > 0:
            top = int(np.searchsorted(lengths[:top], room, side="right"))
            if top == 0:
                break
            n = int(min(counts[top - 1], room // lengths[top - 1]))
            one[top - 1] = n
            room -= n * int(lengths[top - 1])
            top -= 1
        times = min(int(counts[i]) // n for i, n in one.items())
        plan[tuple((int(lengths[i]), n) for i, n in one.items())] += times
        for i, n in one.items():
            counts[i] -= n * times
        kept = counts > 0
        lengths, counts = lengths[kept], counts[kept]


def _placer(histogram: dict[int, int], plan):
    """Sequence and offset of the piece at each position of the order (length, ...)."""
    before, total = {}, 0
    for length in sorted(histogram):
        before[length] = total
        total += histogram[length]
    at, sequence, starts = dict(before), 0, []
    for configuration, times in plan:
        offset = 0
        for length, n in configuration:
            starts.append((at[length], sequence, n, offset, length))
            at[length] += n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(starts), dtype=np.int64).reshape(-1, 5)

    def place(batches):
        for batch in batches:
            position = batch.column("position").to_numpy() - 1
            row = table[np.searchsorted(table[:, 0], position, side="right") - 1]
            within = position - row[:, 0]
            names = [name for name in batch.schema.names if name != "position"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in names],
                    pa.array(row[:, 1] + within // row[:, 2]),
                    pa.array(row[:, 3] + within % row[:, 2] * row[:, 4]),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    return place


def pack(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, gapless within each sequence."""
    cut_ = pieces(docs, vocabulary, capacity, keep_ids)
    histogram = {row["length"]: row["count"] for row in cut_.groupBy("length").count().collect()}
    plan = solve(histogram, capacity, rounds)
    order = [F.col("length"), F.col("doc_id"), F.col("piece")]
    ranked = global_row_number(cut_, order, "position")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_.schema.fields)
    return ranked.select(*cut_.columns, "position").mapInArrow(
        _placer(histogram, plan), schema + ", sequence_id bigint, offset bigint"
    )
