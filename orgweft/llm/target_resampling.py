"""Importance resampling of documents towards a target collection, on hashed n-grams.

Every text is a bag of features: its words and all runs of consecutive words up to a length.
A feature's bucket is its CRC modulo the number of buckets. The log ratio of a bucket's share
in the target to its share in the documents is its gain; a document's weight is the mean gain of
its features. Weights with Gumbel noise, which a hash of the id gives, rank the documents, and
the first ones are a draw without replacement in proportion to the exponential of the weights.

Both passes over the texts run Arrow kernels on runs of some ``RUN_BYTES``: ``ascii_lower``,
``split_pattern_regex`` and ``list_flatten`` make words, ``dictionary_encode`` makes numbers of
them. A run of words is the shifted numbers folded two by two, each fold encoded again, so that
only distinct runs are spelled out and hashed. The first pass sends one count per bucket and
task; the second takes each feature's gain and reduces by document. The driver holds the counts
and gains of the buckets, whose number is a parameter. Ranks come from a range sort.

Defined results: null, empty or wordless texts have no features and weight 0. A null ``doc_id``
is hashed as an empty one and comes after other ids of its score. Rows with one id each take
part; they share their noise. Ties go to the smaller id, then to the larger weight. Very long
texts are runs of their own. Extra columns are ignored; an empty table gives no rows, and
without a target every bucket has the target count 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.functions.ranking import global_row_number
from orgweft.llm.stages import stored

# Bytes that part words once A to Z are lower-cased: words are digits, a to z and all beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10000
RUN_WORDS = 2
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
SCALE = 1000
RUN_BYTES = 8 << 20


def crcs(values: pa.Array) -> np.ndarray:
    """Unsigned CRC-32 of the UTF-8 bytes of each string."""
    raw = values.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))


def features(texts: pa.Array, run_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the bucket and text of every feature, in no order."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    filled = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(filled).dictionary_encode()
    owner = owner.filter(filled).to_numpy()
    words = coded.dictionary
    number = coded.indices.to_numpy().astype(np.int64)
    found, owners = [], []
    spelled, code = words, number  # of the runs that start at each place
    for length in range(1, run_words + 1):
        if length > 1:
            inside = owner[length - 1 :] == owner[: len(owner) - length + 1]
            folded = code[: len(inside)] * max(1, len(words)) + number[length - 1 :]
            runs = pa.array(folded[inside]).dictionary_encode()
            distinct = runs.dictionary.to_numpy()
            spelled = pc.binary_join_element_wise(
                spelled.take(pa.array(distinct // max(1, len(words)))),
                words.take(pa.array(distinct % max(1, len(words)))),
                pa.scalar(" ", pa.large_utf8()),
            )
            # Places whose run leaves the text stay at code 0; longer runs leave it as well.
            code = np.zeros(len(inside), np.int64)
            code[inside] = runs.indices.to_numpy()
        else:
            inside = np.ones(len(owner), dtype=bool)
        bucket = pa.array(crcs(spelled) % buckets)
        found.append(bucket.take(pa.array(code[inside])).to_numpy())
        owners.append(owner[: len(inside)][inside])
    return np.bincount(owner, minlength=len(texts)), np.concatenate(found), np.concatenate(owners)


def _runs(texts: pa.Array):
    """``(from, texts)`` in runs of some ``RUN_BYTES`` (one text at least); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + RUN_BYTES, side="right")))
        yield at, texts[at:to]
        at = to


def _counter(run_words: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _runs(batch.column("text")):
                total += np.bincount(features(part, run_words, buckets)[1], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, run_words: int = RUN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all features of all texts; buckets without any are left out."""
    return (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(_counter(run_words, buckets), "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )


def gains(
    docs: DataFrame, target: DataFrame, run_words: int = RUN_WORDS, buckets: int = BUCKETS
) -> np.ndarray:
    """Each bucket's scaled log ratio of smoothed shares, rounded down."""
    counts = []
    for table in (docs, target):
        own = np.zeros(buckets, np.float64)
        for row in bucket_counts(table, run_words, buckets).collect():
            own[row["bucket"]] = row["n"]
        counts.append(own)
    s, t = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def _weigher(run_words: int, buckets: int, gain: np.ndarray):
    taken = pa.array(gain)

    def run(batches):
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for _, part in _runs(batch.column("text")):
                words, bucket, owner = features(part, run_words, buckets)
                order = np.argsort(owner, kind="stable")
                count = np.bincount(owner, minlength=len(part))
                sums = np.concatenate(([0], np.cumsum(taken.take(pa.array(bucket[order])).to_numpy())))
                at = np.concatenate(([0], np.cumsum(count)))
                n_words.append(words)
                n_features.append(count)
                weight.append((sums[at[1:]] - sums[at[:-1]]) // np.maximum(count, 1))
            if not n_words:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(np.concatenate(x).astype(np.int64)) for x in (n_words, n_features, weight)],
                ],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Scaled Gumbel noise of an id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 32))))).cast(
        "bigint"
    )


def scored(
    docs: DataFrame,
    target: DataFrame,
    run_words: int = RUN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` per row, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _weigher(run_words, buckets, gains(docs, target, run_words, buckets)),
        f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint",
    )
    return stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    run_words: int = RUN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` per row; ``rank`` is null for rows not drawn.

    Drawn are ``percent`` of the rows with at least ``least_words`` words, rounded down.
    """
    rows = scored(docs, target, run_words, buckets, seed)
    eligible = rows.where(F.col("n_words") >= least_words)
    draw = eligible.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    ranked = global_row_number(eligible, order, "rank").withColumn(
        "rank", F.when(F.col("rank") <= draw, F.col("rank").cast("bigint"))
    )
    others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is spelled out with its reflected polynomial, as DuckDB has no such function.
SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
bags AS (
  SELECT side, id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
features AS (SELECT side, id, unnest(f) AS f FROM bags),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(f)) + 1),
      lambda k: CAST('0x' || substr(hex(encode(f)), 2 * k - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc_table),
placed AS (SELECT side, id, bucket FROM features JOIN hashed USING (f)),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM placed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS gain
  FROM counts, totals),
weights AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS total
  FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
noisy AS (
  SELECT id, n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h
  FROM bags LEFT JOIN weights USING (id) WHERE side = 'd'),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM noisy),
ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place,
    count(*) OVER () * 25 // 100 AS draw
  FROM scored WHERE n_words >= 20)
SELECT id AS doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN place <= draw THEN place::BIGINT END AS rank
FROM scored LEFT JOIN ranked USING (id)"""
