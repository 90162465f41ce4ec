"""Words, the n-gram join and the repeats against plain Python."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from orgweft.llm import ngram_join, suffix_repeats, words

from .plain import ODD, WORD, kept_words, link_components, prose, rows, shingle_set


def test_words_are_those_of_the_pattern():
    texts = [*ODD, "a\xa0b c", "tail ", " head", "A bC\x85d", "\x0c\x0b"]
    seen = {}
    for lower in (False, True):
        for start, stop, block in words.blocks(pa.array(texts), lower):
            for i in range(start, stop):
                first, last = block.first[i - start], block.first[i - start + 1]
                own = WORD.findall((texts[i] or "").encode().lower().decode() if lower else texts[i] or "")
                got = [
                    block.buffer[a:b].tobytes().decode()
                    for a, b in zip(block.starts[first:last], block.ends[first:last], strict=True)
                ]
                assert got == own
                for word, h in zip(own, block.hashes[first:last].tolist(), strict=True):
                    assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def near_copies(seed: int) -> list[str | None]:
    draw = random.Random(seed)
    out: list[str | None] = [*ODD, "one two three four five six", "ONE two three four five six"]
    for family in range(6):
        base = prose(seed * 100 + family, draw.choice([5, 9, 30, 80, 200]))
        for _ in range(draw.randrange(1, 12)):
            own = list(base)
            for _ in range(draw.randrange(0, max(2, len(own) // 25))):
                own[draw.randrange(len(own))] = f"new{draw.randrange(9)}"
            out.append(" ".join(own[: len(own) - draw.randrange(0, 3)]))
    return out


@pytest.mark.parametrize("seed,size,percent,tile", [(1, 4, 85, 10**7), (2, 5, 80, 300), (3, 3, 70, 100)])
def test_join_components(spark, seed, size, percent, tile):
    texts = near_copies(seed)
    ids = [None if n == 4 else 7 * n % 1000 + 3 for n in range(len(texts))]
    got = ngram_join.components(rows(spark, texts, ids), size, percent, tile).collect()
    docs = list(zip(ids, texts, strict=True))
    expected = link_components(docs, size, percent)
    sizes = {i: len(shingle_set(t, size)) for i, t in docs}
    assert len(got) == len(texts)
    for row in got:
        assert row.n_shingles == sizes[row.doc_id]
        assert row.component_id == (None if row.doc_id is None else expected[row.doc_id])


def test_filter_keeps_every_shared_key(spark):
    draw = np.random.default_rng(2)
    keys = draw.integers(-(2**63), 2**63 - 1, 3000)
    edges = [0, 1, 32768, 32769, ngram_join.FILTER_BITS - 1, ngram_join.FILTER_BITS, -1]
    every = np.concatenate([keys, edges, [5 * ngram_join.FILTER_BITS + 77]])
    frame = spark.createDataFrame([(int(k),) for k in every], "h bigint")
    bits = ngram_join.key_filter(frame)
    assert ngram_join._passing(bits, every.view(np.uint64)).all()
    assert ngram_join._passing(bits, draw.integers(-(2**63), 2**63 - 1, 20000).view(np.uint64)).mean() < 0.01
    assert not ngram_join._passing(ngram_join.key_filter(frame.limit(0)), every.view(np.uint64)).any()


def test_representatives_of_shared_ids_and_clashing_names(spark):
    base = " ".join(prose(1, 40))
    data = [(1, base, "a"), (1, base, "a"), (1, " ".join(prose(2, 40)), "b"), (2, base, None), (3, "x y", "c"), (None, base, "d"), (None, base, "d"), (4, None, "e")]
    docs = spark.createDataFrame(data, "doc_id int, text string, _kept string").withColumnsRenamed({})
    for clash in ("id", "mark", "row", "component_id", "d1"):
        docs = docs.withColumn(clash, docs["_kept"])
    one = ngram_join.representatives(docs.repartition(5)).collect()
    two = ngram_join.representatives(docs.coalesce(1)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    assert sorted((r.doc_id or 0) for r in one) == [0, 0, 1, 3, 4]
    assert ngram_join.representatives(docs.limit(0)).collect() == []


def test_every_pair_that_links_shares_a_key():
    draw = np.random.default_rng(5)
    for percent in (80, 85):
        for n in (1, 2, 3, 6, 7, 8, 13, 40, 150, 900):
            for _ in range(40):
                a = np.unique(draw.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
                b = a.copy()
                while True:
                    less = np.delete(b, draw.integers(len(b))) if draw.random() < 0.5 and len(b) > 1 else b
                    more = np.unique(np.append(less, np.uint64(draw.integers(2**62)))) if less is b else less
                    common = len(np.intersect1d(a, more))
                    if 100 * common < percent * (len(a) + len(more) - common):
                        break
                    b = more
                tops = ngram_join.bands(percent, max(len(a), len(b)))
                found = []
                for own in (a, b):
                    band = int(np.searchsorted(tops, len(own)))
                    mine = [ngram_join.keys(own, band, int(tops[band]), percent)]
                    if 100 * len(own) // percent > tops[band]:
                        mine.append(ngram_join.keys(own, band + 1, int(tops[band + 1]), percent))
                    found.append(np.concatenate(mine))
                assert len(np.intersect1d(*found))


def test_first_keys_of_linked_sets_meet_in_any_order():
    draw = np.random.default_rng(6)
    for percent in (80, 85):
        for n in (3, 8, 13, 40, 150, 900, 2500):
            for _ in range(30):
                a = np.unique(draw.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
                b, changes = a, (100 - percent) * n // (100 + percent)
                if draw.random() < 0.5:  # a subset, as small as links allow
                    b = np.sort(draw.permutation(a)[: ngram_join.needed(n, percent)])
                elif changes:
                    b = np.concatenate([draw.permutation(a)[changes:], draw.integers(2**62, size=changes).astype(np.uint64)])
                    b = np.unique(b)
                common = len(np.intersect1d(a, b))
                assert 100 * common >= percent * (len(a) + len(b) - common)
                tops, salt = ngram_join.bands(percent, n), np.uint64(draw.integers(2**62))
                place = int(np.searchsorted(tops, n))  # the pair's band
                counted = []
                for own in (a, b):
                    own_keys, room = ngram_join.keys_and_room(own, place, int(tops[place]), percent)
                    places = len(own_keys) + min(room, 0)
                    counted.append(own_keys[np.argsort(words.mix(own_keys ^ salt))][: max(places, 0)])
                assert len(np.intersect1d(*counted))


def test_sets_that_share_a_passage_are_no_candidates(spark):
    passage = prose(77, 60)
    texts = [" ".join([*prose(200 + n, 200, 10**6), *passage, *prose(300 + n, 140, 10**6)]) for n in range(40)]
    texts = rows(spark, [*texts, texts[3] + " end"]).select("text")
    ties = ngram_join._ties(texts, 5, 80).collect()
    assert len(ties) == 1


def test_representatives_keep_columns_and_one_row(spark):
    texts = ["a b c d e f g", "a b c d e f g", "z", None, None]
    docs = rows(spark, texts, [5, 2, 9, None, 4]).union(rows(spark, ["a b c d e f g"], [2]))
    got = ngram_join.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "4", "9", "None"]


def test_join_of_nothing(spark):
    assert ngram_join.components(rows(spark, [])).collect() == []


def shared_passages(seed: int) -> list[str | None]:
    draw = random.Random(seed)
    passages = [prose(seed + n, draw.randrange(10, 40)) for n in range(5)]
    out: list[str | None] = list(ODD)
    for n in range(40):
        own = prose(1000 * seed + n, draw.randrange(0, 60), 4000)
        for _ in range(draw.randrange(0, 3)):
            at = draw.randrange(len(own) + 1)
            own[at:at] = draw.choice(passages)
        out.append(draw.choice([" ", "\n", " \t"]).join(own))
    return [*out, out[-1], out[-2]]


@pytest.mark.parametrize("seed,size,groups", [(1, 13, 8), (2, 13, 1), (3, 6, 8)])
def test_repeats(spark, monkeypatch, seed, size, groups):
    monkeypatch.setattr(suffix_repeats, "GROUPS_PER_PARTITION", groups)
    texts = shared_passages(seed)
    ids = [None if n == 9 else 11 * n % 997 for n in range(len(texts))]
    got = suffix_repeats.remove(rows(spark, texts, ids), size).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    mine = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=order)
    assert mine == sorted(kept_words(list(zip(ids, texts, strict=True)), size), key=order)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_repeats_in_one_text_or_under_one_id_stay(spark):
    text = " ".join(prose(9, 30) * 2)
    got = suffix_repeats.remove(rows(spark, [text, text + " x"], [3, 3])).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert suffix_repeats.remove(rows(spark, [])).collect() == []


def test_frequent_prefixes_hold_one_block_at_a_time():
    """Executors ran out of memory when the hashes of a whole batch were held."""
    text = " ".join(prose(8, 2000, 3000)) + " "
    text *= (1 << 20) // len(text) + 1

    def peak(n):
        batch = pa.RecordBatch.from_arrays([pa.array([text] * n)], names=["text"])
        run = suffix_repeats._frequent_prefixes(13, 64)
        for _ in run(iter([batch])):  # tables of powers are made once
            break
        tracemalloc.start()
        try:
            rows_ = sum(out.num_rows for out in run(iter([batch])))
            return rows_, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(2)[0] > 0
    assert peak(24)[1] < 1.5 * peak(4)[1]
