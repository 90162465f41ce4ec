"""Whitening, importance resampling and token counts against plain Python and NumPy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orgweft.llm import catalog, target_resampling, token_counts, whitening

from .plain import ODD, lower, prose, rows

DATA = "/root/testdata/sf0.001"

# --- whitening ------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, index bigint, x string, part int, vector string"


def vectors(spark, pairs):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, 7, "x", 3, "v") for i, v in pairs], VECTORS)


def plain_whitening(arrays, components=8):
    x = np.floor(np.array(arrays, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum(int(c) ** 2 for c in row) for row in n * x - s]
    return deviation, centred @ axes[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


@pytest.mark.parametrize("entries", [whitening.BLOCK_ENTRIES, 24])
def test_whitening_equals_numpy(spark, monkeypatch, entries):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)  # many blocks of rows
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 1024 if entries > 24 else 5)  # and of columns
    draw = np.random.default_rng(3)
    good = (draw.normal(size=(60, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    good += [good[0]] * 25  # copies
    pairs = [(i if i != 4 else None, v) for i, v in enumerate(good)]
    pairs[7] = (6, good[7])  # one id twice, with two vectors
    bad = [None, [], [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [1.0] * 11 + [float("-inf")], [1.0, 2.0], [1.0] * 13]
    got = whitening.whiten(vectors(spark, [*pairs, *enumerate(bad, 900)]).repartition(6)).collect()
    deviation, whitened, explained = plain_whitening(good)
    assert len(got) == 8 * len(good)
    assert {r.n for r in got} == {len(good)} and {r.identity_error < 1e-9 for r in got} == {True}
    signs = {}
    for c in range(8):
        top = max((r for r in got if r.component == c + 1), key=lambda r: abs(r.whitened))
        signs[c] = np.sign(top.whitened) * np.sign(whitened[np.abs(whitened[:, c]).argmax(), c])
        assert {round(r.explained, 10) for r in got if r.component == c + 1} == {round(explained[c], 10)}
    key = lambda i, d, c, w: (i is None, i or 0, d, c, round(float(w), 8) + 0.0)
    mine = sorted(key(r.vec_id, r.deviation, r.component, r.whitened) for r in got)
    plain = sorted(
        key(pairs[i][0], deviation[i], c + 1, whitened[i, c] * signs[c]) for i in range(len(good)) for c in range(8)
    )
    assert [m[:4] for m in mine] == [p[:4] for p in plain]
    assert np.allclose([m[4] for m in mine], [p[4] for p in plain], atol=1e-7)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {
        (1, 2, 0, None, None, None),
        (2, 2, 0, None, None, None),
    }
    line = whitening.whiten(vectors(spark, [(1, [0.5, 0.0]), (2, [-0.5, 0.0])])).collect()
    assert sorted((r.component, abs(r.whitened or 0), r.explained) for r in line) == [
        (1, 1.0, 1.0), (1, 1.0, 1.0), (2, 0, 0.0), (2, 0, 0.0),
    ]
    assert all(r.identity_error < 1e-9 for r in line)


def test_whitening_query(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = catalog.QUERIES["op11_blockmatrix_whitening"](spark, DATA).collect()
    whole = {r.vec_id: r.embedding for r in table.collect()}
    deviation, whitened, _ = plain_whitening(list(whole.values()))
    place = {i: k for k, i in enumerate(whole)}
    for c in range(8):
        own = [r for r in got if r.component == c + 1]
        mine, plain = np.array([r.whitened for r in own]), whitened[[place[r.vec_id] for r in own], c]
        assert np.allclose(mine, plain, atol=1e-8) or np.allclose(mine, -plain, atol=1e-8)
        assert [r.deviation for r in own] == [deviation[place[r.vec_id]] for r in own]
    assert len(got) == 8 * len(whole) and got[0].identity_error < 1e-4


# --- importance resampling ------------------------------------------------------

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    own = PLAIN_WORD.findall(lower(text))
    return own, [" ".join(own[i : i + k]) for k in range(1, longest + 1) for i in range(len(own) - k + 1)]


def plain_resample(docs, target, longest=2, buckets=10000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for text in docs:
        s.update(map(bucket, plain_features(text[1], longest)[1]))
    for text in target:
        t.update(map(bucket, plain_features(text, longest)[1]))
    top, low = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * top / ((s[b] + 1) * low))) for b in s}
    out = []
    for i, text in docs:
        own, found = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // max(len(found), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(found), weight, score, len(own) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    place = {id(r): n + 1 for n, r in enumerate(order[: len(order) * percent // 100])}
    return [(*r[:4], place.get(id(r))) for r in out]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_equals_plain(spark, monkeypatch, longest):
    monkeypatch.setattr(target_resampling, "RUN_BYTES", 2000)
    texts = [*ODD, "É é ÀB-cd", "a-b_c`d{e~f\x7fg\x000", "北京 naïve A1", *(" ".join(prose(n, 5 + 3 * n, 40)) for n in range(40))]
    texts += [" ".join(prose(1, 20000, 60)), texts[-1], texts[-1], "the end " * 30]
    ids = [*range(len(texts) - 3), len(texts) - 4, None, 70]  # an id twice with one text, no id
    target = [" ".join(prose(90 + n, 30, 25)) for n in range(20)] + [None, ""]
    bench = spark.createDataFrame([(n, t, 0) for n, t in enumerate(target)], "item_id int, text string, n int")
    got = target_resampling.resample(rows(spark, texts, ids), bench, run_words=longest).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    plain = plain_resample(list(zip(ids, texts, strict=True)), target, longest)
    assert sorted(map(tuple, got), key=key) == sorted(plain, key=key)
    assert sum(r.rank is not None for r in got) > 5


def test_resampling_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert target_resampling.resample(rows(spark, []), bench).collect() == []
    texts = [" ".join(prose(n, 30)) for n in range(8)]
    got = target_resampling.resample(rows(spark, texts), bench.limit(0)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_resample(list(enumerate(texts)), []), key=key)
    odd = target_resampling.resample(rows(spark, [None, "", " -- "]), bench).collect()
    assert all((r.n_features, r.weight, r.rank) == (0, 0, None) for r in odd)


# --- token counts ---------------------------------------------------------------


def odd_texts(count):
    draw = random.Random(5)
    parts = [*"ab Z'12 \n\t\r\x0b\x0c.,!-é 　中。́😀\x1c\x85 ", "<|endoftext|>", "'s", "'LL", "  ", "|>", "<|", "word ", "**"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(count)]


@pytest.mark.parametrize("run_bytes,call_bytes,known", [(16 << 20, 1 << 18, 1 << 19), (300, 50, 20)])
def test_counts_equal_whole_texts(monkeypatch, run_bytes, call_bytes, known):
    for name, value in (("RUN_BYTES", run_bytes), ("CALL_BYTES", call_bytes), ("KNOWN_PIECES", known)):
        monkeypatch.setattr(token_counts, name, value)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*odd_texts(3000), *ODD, " ".join(prose(2, 20000)), "ab" * 20000, None]
    array = pa.array(texts)
    for part in (array, array.slice(7, 2000), array.slice(5, 0)):
        n_bytes, n_tokens = token_counts.token_lengths(part, token_counts.Counter())
        plain = [t or "" for t in part.to_pylist()]
        assert n_bytes.tolist() == [len(t.encode()) for t in plain]
        assert n_tokens.tolist() == [len(whole.encode(t, add_special_tokens=False).ids) for t in plain]


def test_counts_of_other_vocabularies():
    texts = [*odd_texts(300), *[t or "" for t in ODD]]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, plain in (
        ("piece_bpe_32k.model", [len(model.encode(t)) for t in texts]),
        ("word_bpe_49k.json", [len(words.encode(t, add_special_tokens=False).ids) for t in texts]),
    ):
        own = token_counts.Counter(name)
        assert own.ends is None
        assert token_counts.token_lengths(pa.array(texts), own)[1].tolist() == plain
    with pytest.raises(ValueError):
        token_counts.Counter("byte_bpe_50k.tiktoken")


def test_count_rows(spark):
    texts = [*ODD, "end <|endoftext|> next", " ".join(prose(1, 900)), "a b", "a b"]
    ids = [*range(len(texts) - 2), None, 0]
    got = token_counts.counts(rows(spark, texts, ids), limit=100).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = []
    for i, t in zip(ids, texts, strict=True):
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        plain.append((i, len((t or "").encode()), n, n > 100))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain, key=key)
    assert token_counts.counts(rows(spark, [])).collect() == []


def test_count_query(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = catalog.QUERIES["op13_token_counts"](spark, DATA).collect()
    assert len(got) == len(table)
    for r in got:
        n = len(whole.encode(table[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 1024)
