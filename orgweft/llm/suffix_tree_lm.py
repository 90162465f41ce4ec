"""A probabilistic suffix tree as language model, and a smoothed unigram as its base.

Texts are scored as sequences of lower-cased words and one end. The tree's symbols are the
bytes of these words, a space between words and a line feed for the end, so every text has
a probability, whatever words it holds.

- Counts of all strings of ``depth + 1`` symbols are gathered from all training texts, and
  those of shorter strings follow from them.
- A context becomes a candidate if it occurs ``MIN_COUNT`` times, however large the corpus.
- Of the candidates, from the longest on, those are kept whose next-symbol distribution
  diverges from that of their own suffix: count times Kullback-Leibler divergence above
  ``MIN_GAIN`` nats. With a context all its suffixes are kept.
- A kept context's distribution is smoothed with its suffix's: ``(count + MASS * P(suffix)) /
  (total + MASS)``; the empty context with a uniform one.
- A symbol is scored by its longest kept context.

The kept contexts grow with the corpus, so counts, contexts and probabilities are stored
tables, a length each, that meet in joins. A context has at most 256 next symbols and a string
as many predecessors, so no key of these joins is large. Strings that only held-out texts hold
are counted 0 times and smoothed like the others, so every string's probability is in the last
table. Its ``HEAD_STRINGS`` most frequent strings go to every task; the others meet their
texts in a join.

The base scores need the count of every word. Words above a fixed share of all tokens,
bounded in number by that share, go to every task; the others meet their counts in a join.

Defined results: a null text is empty and consists of the end alone; rows that repeat a
``doc_id`` are scored each for itself, repeated equal rows alike; a null ``doc_id`` counts as the
empty string for its fold; with no training text every symbol is as likely, and ``c = N = V =
0`` in the base. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweft.llm import words as w
from orgweft.llm.stages import stored

FOLDS = 10
DEPTH = 6
MIN_COUNT = 2
MIN_GAIN = 10.0
MASS = 8.0
HEAD_SHARE = 4e-6
END_HASH = int(w.mix(np.array([0x0A], dtype=np.uint64))[0])
SYMBOLS = 256
CHUNK_BYTES = 2 << 20
HELD_STRINGS = 1_000_000
HEAD_STRINGS = 3_000_000


# --- strings of symbols ---------------------------------------------------------


def _chunks(texts: pa.Array):
    """``from, to`` of runs of texts of some bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), CHUNK_BYTES)))
        yield start, min(stop, len(sizes))
        start = stop


def _stream(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the ``depth + 1`` symbols that end at each symbol of each text (the bytes of a
    code, the latest lowest), where each text's codes begin, and how many words it has.
    Before a text there are only line feeds.
    """
    pad = b"\n" * depth
    parts, sizes, words = [], [], []
    for text in texts:
        own = (text or "").encode("utf-8", "replace").lower().split()
        part = pad + b" ".join(own) + b"\n"
        parts.append(part)
        sizes.append(len(part))
        words.append(len(own))
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array(sizes, dtype=np.int64)
    count = len(data) - depth
    code = np.zeros(max(count, 0), dtype=np.uint64)
    for place in range(depth + 1):
        code <<= np.uint64(8)
        code |= data[place : place + count]
    # The last codes of a text reach into the next one.
    own = np.ones(len(data), dtype=bool)
    ends = np.cumsum(sizes)
    for back in range(1, depth + 1):
        own[ends - back] = False
    first = np.concatenate(([0], np.cumsum(sizes - depth)))[:-1]
    return code[own[:count]], first, np.array(words, dtype=np.int64)


def _added(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by value."""
    order = np.argsort(value, kind="stable")  # linear, as the values are a few sorted runs
    value, count = value[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    return value[first], np.add.reduceat(count, first)


def _counter(depth: int):
    """Counts of strings in training texts, ``n``, and in all, ``m``, summed within a task as
    long as they fit.
    """

    def row(value, count, held_out):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(w.signed(value)),
                pa.array((count * (not held_out)).astype(np.int64)),
                pa.array(count.astype(np.int64)),
            ],
            names=["code", "n", "m"],
        )

    def run(batches):
        sums = {kind: (np.empty(0, np.uint64), np.empty(0, np.int64)) for kind in (False, True)}
        for batch in batches:
            for held_out in sums:
                texts = batch.filter(pc.equal(batch.column("held_out"), held_out)).column("text")
                for start, stop in _chunks(texts):
                    value, count = sums[held_out]
                    code, _, _ = _stream(texts[start:stop].to_pylist(), depth)
                    new, times = np.unique(code, return_counts=True)
                    value, count = _added(np.concatenate([value, new]), np.concatenate([count, times]))
                    if len(value) > HELD_STRINGS:
                        yield row(value, count, held_out)
                        value, count = value[:0], count[:0]
                    sums[held_out] = value, count
        for held_out, (value, count) in sums.items():
            if len(value):
                yield row(value, count, held_out)

    return run


# --- the tree -------------------------------------------------------------------


class Tree:
    """Kept contexts and their smoothed next-symbol distributions, as sorted arrays per length."""

    def __init__(self, contexts: dict[int, tuple], root: np.ndarray, depth: int):
        self.depth = depth
        self.root = root  # log10 probabilities
        #: length -> contexts, log10 of what falls to the suffix, pairs (context, symbol), log10
        self.contexts = contexts

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of the last symbol of each code after the symbols before it."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        for length in sorted(self.contexts, reverse=True):
            known, escape, pairs, values = self.contexts[length]
            if not len(known) or not len(open_):
                continue
            pair = codes[open_] & np.uint64((1 << (8 * (length + 1))) - 1)
            context = pair >> np.uint64(8)
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            inside = known[at] == context
            place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            found = inside & (pairs[place] == pair)
            out[open_[found]] += values[place[found]]
            less = inside & ~found
            out[open_[less]] += escape[at[less]]
            open_ = open_[~found]
        out[open_] += self.root[(codes[open_] & np.uint64(255)).astype(np.int64)]
        return out


def _index(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.searchsorted(sorted_values, wanted)


def grow(rows: dict[int, tuple[np.ndarray, np.ndarray]], min_gain: float, mass: float) -> Tree:
    """The tree from ``length -> (codes of context and symbol, counts)``, both lengths' codes
    sorted and complete for every candidate context. This is ``probabilities`` for counts that
    fit one process.
    """
    depth = max(rows)
    root_counts = np.zeros(SYMBOLS)
    codes, counts = rows[0]
    root_counts[codes.astype(np.int64)] = counts
    root = (root_counts + 0.1) / (root_counts.sum() + 0.1 * SYMBOLS)
    # Candidates: contexts, totals, and for each pair the position of its context.
    tables = {}
    for length in range(1, depth + 1):
        codes, counts = rows[length]
        context = codes >> np.uint64(8)
        known, first = np.unique(context, return_index=True)
        total = np.add.reduceat(counts, first).astype(float) if len(known) else np.empty(0)
        owner = np.searchsorted(known, context)
        tables[length] = (known, total, codes, counts.astype(float), owner)
    # Divergence of each candidate from its suffix; both are unsmoothed.
    kept: dict[int, np.ndarray] = {}
    for length in range(depth, 0, -1):
        known, total, codes, counts, owner = tables[length]
        if not len(known):
            kept[length] = np.zeros(0, dtype=bool)
            continue
        if length == 1:
            below = root_counts[(codes & np.uint64(255)).astype(np.int64)] / max(root_counts.sum(), 1)
        else:
            _, shorter_total, shorter, shorter_counts, shorter_owner = tables[length - 1]
            place = _index(shorter, codes & np.uint64((1 << (8 * length)) - 1))
            below = shorter_counts[place] / shorter_total[shorter_owner[place]]
        gain = np.zeros(len(known))
        np.add.at(gain, owner, counts * np.log(counts / total[owner] / below))
        keep = gain > min_gain
        if length < depth and len(tables[length + 1][0]):
            longer = tables[length + 1][0][kept[length + 1]]
            keep[_index(known, longer & np.uint64((1 << (8 * length)) - 1))] = True
        kept[length] = keep
    # Smoothing, from the shortest on: a pair's probability needs its suffix's.
    out: dict[int, tuple] = {}
    tree = Tree(out, np.log10(root), depth)
    for length in range(1, depth + 1):
        known, total, codes, counts, owner = tables[length]
        chosen = kept[length][owner] if len(known) else np.zeros(0, dtype=bool)
        pairs = codes[chosen]
        below = 10 ** tree.score(pairs & np.uint64((1 << (8 * length)) - 1)) if len(pairs) else np.empty(0)
        value = (counts[chosen] + mass * below) / (total[owner[chosen]] + mass)
        escape = mass / (total[kept[length]] + mass) if len(known) else np.empty(0)
        out[length] = (known[kept[length]] if len(known) else known, np.log10(escape), pairs, np.log10(value))
    return tree


def _context() -> Column:
    return F.shiftrightunsigned("code", 8)


def _suffix(column: str, symbols: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def probabilities(
    rows: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN, mass: float = MASS
) -> DataFrame:
    """``code, m, p``: each string of ``depth + 1`` symbols of ``text, held_out``, how often it
    occurs and the probability of its last symbol after the others, learnt from the training rows.
    """
    strings = stored(
        rows.select("text", "held_out")
        .mapInArrow(_counter(depth), "code bigint, n bigint, m bigint")
        .groupBy("code")
        .agg(F.sum("n").alias("n"), F.sum("m").alias("m")),
        "strings",
    )
    symbols = strings.agg(F.sum("n")).first()[0] or 0
    counts = {}
    for length in range(depth, -1, -1):
        here = strings
        if length < depth:
            # Dropping the earliest symbol shortens a context.
            here = counts[length + 1].groupBy(_suffix("code", length + 1).alias("code")).agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy(_context())) if length else F.lit(symbols).cast("bigint")
        counts[length] = stored(here.withColumn("total", total), "counts")
    kept = {}
    for length in range(depth, 0, -1):
        shorter = counts[length - 1].where("n > 0").select(
            F.col("code").alias("suffix"), F.try_divide("n", "total").alias("below")
        )
        here = (
            counts[length]
            .where((F.col("n") > 0) & (F.col("total") >= min_count))
            .join(shorter, _suffix("code", length) == F.col("suffix"))
            .groupBy(_context().alias("context"))
            .agg(F.sum(F.col("n") * F.log(F.try_divide("n", "total") / F.col("below"))).alias("gain"))
            .where(F.col("gain") > min_gain)
            .select("context")
        )
        if length < depth:
            here = here.union(kept[length + 1].select(_suffix("context", length))).distinct()
        kept[length] = stored(here, "contexts")
    out = counts[0].select("code", ((F.col("n") + 0.1) / (F.col("total") + 0.1 * SYMBOLS)).alias("p"))
    for length in range(1, depth + 1):
        shorter = out.select(F.col("code").alias("suffix"), F.col("p").alias("below"))
        smooth = (F.col("n") + mass * F.col("below")) / (F.col("total") + mass)
        out = (
            counts[length]
            .join(kept[length], _context() == F.col("context"), "left")
            .join(shorter, _suffix("code", length) == F.col("suffix"))
            .select(
                "code",
                *(["m"] if length == depth else []),
                F.when(F.col("context").isNotNull(), smooth).otherwise(F.col("below")).alias("p"),
            )
        )
    return stored(out, "probabilities")


def _most_frequent(strings: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and log10 probabilities of the most frequent strings, ``size`` at most, sorted."""
    step = F.floor(F.log2("m") * 64)
    least, held = None, 0
    for at, count in sorted(strings.groupBy(step).count().collect(), reverse=True):
        held += count
        if held > size:
            break
        least = at
    if least is None:
        return np.empty(0, np.uint64), np.empty(0)
    head = strings.where(step >= least).select("code", "p").toArrow()
    code = head.column("code").to_numpy().view(np.uint64)
    order = np.argsort(code)
    return code[order], np.log10(head.column("p").to_numpy()[order])


# --- the base -------------------------------------------------------------------


def _word_counts(batches):
    for batch in batches:
        hashes = [np.full(batch.num_rows, END_HASH, dtype=np.uint64)]
        for _, _, block in w.blocks(batch.column("text"), lower=True):
            hashes.append(block.hashes)
        value, count = np.unique(np.concatenate(hashes), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(w.signed(value)), pa.array(count.astype(np.int64))], names=["h", "n"]
        )


def vocabulary(texts: DataFrame) -> DataFrame:
    """``h, c``: how often each word occurs; the end of a text is a word like others."""
    return stored(
        texts.mapInArrow(_word_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c")),
        "vocabulary",
    )


class _Places:
    """Where values lie in a sorted table of distinct ones: by the slot of their hash. Those of the
    table that lose their slot to another have one among fewer, the last few are searched.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.levels = []
        self.left = np.arange(len(table), dtype=np.int32)
        factor = 0x9E3779B97F4A7C15
        while len(self.left) > 16 and len(self.levels) < 8:
            bits = len(self.left).bit_length() + 1
            slots = np.full(1 << bits, -1, dtype=np.int32)
            own = _slot(table[self.left], factor, bits)
            slots[own] = self.left
            self.levels.append((factor, bits, slots))
            self.left = self.left[slots[own] != self.left]
            factor = factor * factor % (1 << 64) + 2

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the table holds each value, and its place there if so."""
        inside = np.zeros(len(values), dtype=bool)
        place = np.zeros(len(values), dtype=np.int32)
        open_, wanted = np.arange(len(values)), values
        for factor, bits, slots in self.levels:
            at = slots[_slot(wanted, factor, bits)]
            found = (self.table[at] == wanted) & (at >= 0)
            inside[open_[found]] = True
            place[open_[found]] = at[found]
            # A value whose slot is empty is not in the table.
            more = ~found & (at >= 0)
            open_, wanted = open_[more], wanted[more]
        if len(self.left) and len(wanted):
            last = self.table[self.left]
            at = np.minimum(np.searchsorted(last, wanted), len(last) - 1)
            found = last[at] == wanted
            inside[open_[found]] = True
            place[open_[found]] = self.left[at[found]]
        return inside, place


def _slot(values: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return ((values * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)


#: What a row of the scorer stands for.
TEXT, WORD, STRING = 0, 1, 2


def _repeats(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return owner[first], value[first], np.diff(np.append(first, len(owner)))


def _scorer(head, frequent, total: int, distinct: int, depth: int):
    """Per text: tokens, those of the head and their base score, and the score of its frequent
    strings; and for its other words a row each, with how often it holds them, and for its other
    strings a row each time.
    """

    def run(batches):
        known, counts = head.value
        strings, values = frequent.value
        below = total + 0.1 * (distinct + 1)
        gain = np.log10((np.append(counts, 0) + 0.1) / below)
        words, codes = _Places(known), _Places(strings)

        def rows(batch, kind, at, h, n, own):
            empty = lambda name: pa.nulls(len(at), batch.schema.field(name).type)
            none = [empty("doc_id"), empty("held_out"), *[pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), kind, np.int32)),
                    batch.column("_id").take(pa.array(at)),
                    batch.column("_tag").take(pa.array(at)),
                    h,
                    n,
                    *(own or none),
                ],
                names=["kind", "_id", "_tag", "h", "n", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

        for batch in batches:
            n_tokens = np.zeros(batch.num_rows, dtype=np.int64)
            n_known = np.zeros(batch.num_rows, dtype=np.int64)
            base = np.zeros(batch.num_rows)
            for start, stop, block in w.blocks(batch.column("text"), lower=True):
                owner = block.owner()
                inside, place = words.find(block.hashes)
                value = np.where(inside, gain[place], 0.0)
                size = stop - start
                n_tokens[start:stop] = np.diff(block.first)
                n_known[start:stop] = np.bincount(owner[inside], minlength=size)
                base[start:stop] = np.bincount(owner, weights=value, minlength=size)
                at, word, n = _repeats(owner[~inside], block.hashes[~inside])
                if len(at):
                    yield rows(batch, WORD, start + at, pa.array(w.signed(word)), pa.array(n), None)
            texts = batch.column("text")
            score = np.zeros(batch.num_rows)
            for start, stop in _chunks(texts):
                code, first, _ = _stream(texts[start:stop].to_pylist(), depth)
                inside, place = codes.find(code)
                value = np.where(inside, values[place], 0.0) if len(values) else np.zeros(len(code))
                score[start:stop] = np.add.reduceat(value, first)
                rare = np.flatnonzero(~inside)
                if len(rare):
                    at = np.searchsorted(first, rare, "right") - 1
                    yield rows(batch, STRING, start + at, pa.array(w.signed(code[rare])), pa.array(np.ones(len(rare), np.int64)), None)
            every = np.arange(batch.num_rows)
            yield rows(
                batch,
                TEXT,
                every,
                pa.nulls(batch.num_rows, pa.int64()),
                pa.nulls(batch.num_rows, pa.int64()),
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(n_tokens + 1),
                    pa.array(n_known),
                    pa.array(base),
                    pa.array(score),
                ],
            )

    return run


def scores(docs: DataFrame, folds: int = FOLDS, head_strings: int = HEAD_STRINGS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row, learnt
    from the rows whose ``crc32`` of ``doc_id`` modulo ``folds`` is not 0.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_id"),
        F.xxhash64("text").alias("_tag"),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    learnt = rows.where("NOT held_out").select("text")
    counts = vocabulary(learnt)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # At most 1 / HEAD_SHARE words reach this share; the end always belongs to them.
    common = counts.where((F.col("c") >= HEAD_SHARE * total) | (F.col("h") == _signed(END_HASH))).toArrow()
    value = common.column("h").to_numpy().view(np.uint64)
    order = np.argsort(value)
    head = spark.sparkContext.broadcast((value[order], common.column("c").to_numpy()[order]))
    ends = dict(zip(value.tolist(), common.column("c").to_pylist(), strict=True)).get(END_HASH, 0)
    strings = probabilities(rows)
    frequent = spark.sparkContext.broadcast(_most_frequent(strings, head_strings))

    below = total + 0.1 * (distinct + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    passed = stored(
        rows.mapInArrow(
            _scorer(head, frequent, total, distinct, DEPTH),
            f"kind int, _id bigint, _tag bigint, h bigint, n bigint, doc_id {kind}, held_out boolean, "
            "n_tokens bigint, n_known bigint, base double, score double",
        ),
        "passed",
    )
    own = passed.where(F.col("kind") == TEXT).drop("kind", "h", "n")
    nothing = {"more_base": F.lit(0.0), "more_known": F.lit(0).cast("bigint"), "more_score": F.lit(0.0), "rows": F.lit(0)}
    part = lambda frame, **given: frame.select(
        "_id", "_tag", *[value.alias(name) for name, value in (nothing | given).items()]
    )
    found = (
        part(
            passed.where(F.col("kind") == WORD).join(counts, "h", "left"),
            more_base=F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / below),
            more_known=F.when(F.col("c") > 0, F.col("n")).otherwise(0),
        )
        .union(
            part(
                passed.where(F.col("kind") == STRING).join(strings.withColumnRenamed("code", "h"), "h"),
                more_score=F.col("n") * F.log10("p"),
            )
        )
        .union(part(own, rows=F.lit(1)))
        .groupBy("_id", "_tag")
        .agg(*[F.sum(name).alias(name) for name in nothing])
    )
    found = stored(found, "rare")
    end = math.log10((ends + 0.1) / below)
    return own.join(found, ["_id", "_tag"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.expr("more_known div rows") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("more_base") / F.col("rows") + end).alias("base_score"),
        (F.col("score") + F.col("more_score") / F.col("rows")).alias("score"),
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value
