"""Language identification in two steps: the family first, the language within it second.

Texts become counts of hashed byte n-grams (two to four, over lower-cased letters, runs of
anything else as one space), relative to their number. Families are told apart by linear
support vector machines, one for each pair of families; within the family that wins most
duels, one machine for each pair of its languages decides. Machines are trained by dual
coordinate descent, each in a task of its own on a bounded sample: ``SAMPLE`` documents of
each language, those with the smallest hash of their id. Everything else sees all rows.

A prediction uses the text alone. Its score is the product of the mean duel probabilities of
the family and of the language, 0 to 1.

Defined results: null texts, and texts without a letter, are ``und`` with score 0, as is
everything if no labelled text can be learnt from. Null and empty languages are not learnt; a
language of unknown family is a family of its own. A null ``doc_id`` counts as the empty
string for its fold. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.functions.ranking import top_per_group
from orgweft.llm.stages import stored

FOLDS = 5
SAMPLE = 300
ORDERS = (2, 3, 4)
BITS = 16
SCALE = 100.0
EPOCHS = 12
COST = 1.0
CHUNK_BYTES = 2 << 20

#: Language families.
FAMILIES: dict[str, tuple[str, ...]] = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga"),
}

_NOT_LETTER = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _letters(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_NOT_LETTER).split()) + b" "


def _chunks(texts: list[str | None]):
    """``from, to``, buckets per order, and where each text's begin; a bucket of ``2 ** BITS``
    marks n-grams that reach into the next text.
    """
    start = 0
    while start < len(texts):
        parts, size, stop = [], 0, start
        while stop < len(texts) and (size < CHUNK_BYTES or stop == start):
            parts.append(_letters(texts[stop] or ""))
            size += len(parts[-1])
            stop += 1
        data = np.frombuffer(b"".join(parts) + b"   ", dtype=np.uint8).astype(np.uint64)
        sizes = np.array([len(part) for part in parts], dtype=np.int64)
        ends = np.cumsum(sizes)
        buckets = []
        for order in ORDERS:
            code = np.full(size, order, dtype=np.uint64)
            for place in range(order):
                code = (code << np.uint64(8)) | data[place : place + size]
            bucket = ((code * _MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int64)
            for back in range(1, order):
                # Every text has three bytes at least, or two if it holds no letter.
                at = ends - back
                bucket[at[at >= 0]] = 1 << BITS
            buckets.append(bucket)
        yield start, stop, buckets, ends - sizes, sizes
        start = stop


def _features(batches):
    for batch in batches:
        found, values, counts = [], [], []
        texts = batch.column("text").to_pylist()
        for start, stop, buckets, first, sizes in _chunks(texts):
            for i in range(stop - start):
                own = np.concatenate([b[first[i] : first[i] + sizes[i]] for b in buckets])
                value, n = np.unique(own[own < 1 << BITS], return_counts=True)
                found.append(value)
                values.append(n * (SCALE / max(1, n.sum())))
                counts.append(len(value))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values))),
            ],
            names=["lang", "bucket", "value"],
        )


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss."""
    weights = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([value @ value + 1.0 for _, value in rows])
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            bucket, value = rows[i]
            gradient = labels[i] * (weights[bucket] @ value + weights[-1]) - 1 + alpha[i] / (2 * COST)
            new = max(alpha[i] - gradient / (norms[i] + 1 / (2 * COST)), 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * labels[i]
                weights[bucket] += step * value
                weights[-1] += step
                alpha[i] = new
    return weights


def _fitter(table: pa.Table) -> pa.Table:
    buckets, values = table.column("bucket").to_pylist(), table.column("value").to_pylist()
    rows = [(np.array(b, np.int64), np.array(v)) for b, v in zip(buckets, values, strict=True)]
    weights = fit(rows, table.column("label").to_numpy().astype(float))
    return pa.table(
        {"duel": table.column("duel")[:1], "weights": pa.array([weights.astype("<f4").tobytes()])}
    )


def train(labelled: DataFrame, sample: int = SAMPLE):
    """Languages by family, and the machines: ``(first, second) -> weights``, positive for the
    first, where both are families or both languages of one family.
    """
    own = labelled.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
    own = own.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("place"))
    chosen = top_per_group(own, ["lang"], [F.col("place")], sample)
    rows = stored(
        chosen.select("lang", "text").mapInArrow(
            _features, "lang string, bucket array<int>, value array<double>"
        ),
        "sample",
    )
    languages = sorted(row["lang"] for row in rows.select("lang").distinct().collect())
    groups: dict[str, list[str]] = {}
    for language in languages:
        groups.setdefault(family(language), []).append(language)
    duels = [
        (("f", a, b), groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)
    ] + [(("l", a, b), [a], [b]) for members in groups.values() for a, b in combinations(members, 2)]
    if not duels:
        return groups, {}
    names = {"\t".join(name): name for name, _, _ in duels}
    sides = [
        (language, "\t".join(name), label)
        for name, first, second in duels
        for label, members in ((1, first), (-1, second))
        for language in members
    ]
    table = rows.sparkSession.createDataFrame(sides, "lang string, duel string, label int")
    fitted = (
        rows.join(table, "lang")
        .select("duel", "label", "bucket", "value")
        .groupBy("duel")
        .applyInArrow(_fitter, "duel string, weights binary")
        .collect()
    )
    return groups, {names[row["duel"]]: np.frombuffer(row["weights"], "<f4") for row in fitted}


def _decide(kind: str, members: list[str], margins: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winner (position in ``members``) and its mean duel probability, per text."""
    size = len(next(iter(margins.values()))) if margins else 0
    votes, chance = np.zeros((len(members), size)), np.zeros((len(members), size))
    for i, j in combinations(range(len(members)), 2):
        p = 1 / (1 + np.exp(-np.clip(2 * margins[kind, members[i], members[j]], -30, 30)))
        votes[i] += p >= 0.5
        votes[j] += p < 0.5
        chance[i] += p
        chance[j] += 1 - p
    # Most duels won, then the surest.
    best = (votes + chance / (2 * len(members))).argmax(axis=0)
    if len(members) == 1:
        return best, np.ones(size)
    return best, chance[best, np.arange(size)] / (len(members) - 1)


def _predictor(shared):
    def run(batches):
        groups, machines = shared.value
        families = sorted(groups)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = np.full(len(texts), "und", dtype=object)
            score = np.zeros(len(texts))
            if groups:
                for start, stop, buckets, first, sizes in _chunks(texts):
                    own = sum(
                        np.add.reduceat((bucket < 1 << BITS).astype(np.int64), first) for bucket in buckets
                    )
                    margins = {("", "", ""): np.zeros(stop - start)}
                    for name, weights in machines.items():
                        table = weights.copy()
                        table[-1] = 0.0
                        total = sum(np.add.reduceat(table[bucket], first, dtype=float) for bucket in buckets)
                        margins[name] = total * (SCALE / np.maximum(own, 1)) + weights[-1]
                    which, sure = _decide("f", families, margins)
                    for number, name in enumerate(families):
                        members = groups[name]
                        language, p = _decide("l", members, margins)
                        here = np.flatnonzero(which == number)
                        found[start + here] = np.array(members, dtype=object)[language[here]]
                        score[start + here] = (sure * p)[here]
            for i, text in enumerate(texts):
                if not has_letter(text):
                    found[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(found.tolist(), pa.string()),
                    pa.array(score),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row, learnt from the rows whose ``crc32`` of
    ``doc_id`` modulo ``folds`` is not 0.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0
    model = train(docs.where(~held_out).select("doc_id", "lang", "text"), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        _predictor(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
