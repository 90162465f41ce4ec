"""Token counts of whole texts, as a public vocabulary's own library gives them.

Batches arrive as Arrow string arrays. Their bytes are cut at safe boundaries, the pieces are
an Arrow array over the same buffer, and the library encodes the distinct pieces of a run of
texts; the lengths go back to the texts by ``take`` and running sums. No ids leave the encoder.

A boundary is safe where a vocabulary can have no token across it. For byte-level vocabularies
without a normalizer or a prefix space, a token holds letters, or digits, or other visible
characters with one space before them at most, or it is white space. So two places part tokens,
and both sides are split alike whether they are seen together or not: before white space that
follows a visible character, and before punctuation that follows a letter or digit. Special
strings lie on one side whole: they hold no white space, and their own characters do not count
as punctuation. Only ASCII white space and punctuation after an ASCII character (or, for white
space, one whose last byte no Unicode space ends with) are used, so no table of characters is
needed. Other vocabularies get whole texts.

Runs of texts hold some ``RUN_BYTES``; a longer text spans several runs, cut at its safe
boundaries. Calls of the library get distinct pieces of some ``CALL_BYTES`` together. So neither
many short nor a few very long texts decide how much memory a task needs; only a single piece
without any safe boundary goes to the library whole, however long. A worker keeps the lengths of
up to ``KNOWN_PIECES`` short pieces that it has met.

Defined results: a null text counts as empty; empty texts have no bytes and no tokens. Rows are
counted one by one, so repeated rows, ties and null ``doc_id`` stay as they are. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
RUN_BYTES = 16 << 20
CALL_BYTES = 1 << 18
KNOWN_PIECES = 1 << 19
KNOWN_LENGTH = 40

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Bytes that end a character which is no white space: visible ASCII, and the last bytes from
# 0xB0 on (those of the Unicode spaces lie below).
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xB0:0xC0] = True
_ALNUM = np.array([n < 128 and chr(n).isalnum() for n in range(256)])
_PUNCTUATION = (np.arange(256) < 0x7F) & _VISIBLE & ~_ALNUM

_counters: dict[str, Counter] = {}


class Counter:
    """Lengths of texts by one vocabulary: the name of a public one, or a file's path, whose
    ending tells the library. ``ends`` tells for each byte whether a piece may start with it
    after a letter or digit; it is None where no safe boundaries are known.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        self.ends: np.ndarray | None = None
        self._known: dict[str, int] = {}
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            with open(path, encoding="utf-8") as file:
                self.ends = _piece_starts(json.load(file))
            self._encode = lambda texts: map(len, own.encode_batch_fast(texts, add_special_tokens=False))
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: map(len, model.encode(texts, num_threads=1))
        else:
            raise ValueError(f"no library for {vocabulary}")

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; calls of the library are balanced by size."""
        found = list(map(self._known.get, texts))
        missing = [i for i, n in enumerate(found) if n is None]
        sizes = np.array([len(texts[i]) for i in missing], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for a, b in runs(starts[:-1], int(starts[-1]), CALL_BYTES):
            own = [texts[i] for i in missing[a:b]]
            for i, text, n in zip(missing[a:b], own, self._encode(own), strict=True):
                found[i] = n
                if len(text) <= KNOWN_LENGTH and len(self._known) < KNOWN_PIECES:
                    self._known[text] = n
        return np.array(found, dtype=np.int64)


def counter(vocabulary: str = VOCABULARY) -> Counter:
    """The worker's counter of a vocabulary."""
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def _piece_starts(settings: dict) -> np.ndarray | None:
    """By a tokenizer file's settings: the punctuation before which a token ends, or None if
    tokens may cross white space.
    """
    split = settings.get("pre_tokenizer") or {}
    special = settings.get("added_tokens") or []
    plain = all(
        not any(map(str.isspace, t["content"])) and not (t["lstrip"] or t["rstrip"] or t["single_word"])
        for t in special
    )
    if (
        settings.get("normalizer") is not None
        or split.get("type") != "ByteLevel"
        or not split.get("use_regex", True)
        or split.get("add_prefix_space", True)
        or not plain
    ):
        return None
    out = _PUNCTUATION.copy()
    out[list("".join(t["content"] for t in special).encode())] = False
    return out


def safe_boundaries(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte whether a piece may start with it: white space that follows a visible
    character, or punctuation that follows a letter or digit.
    """
    left, right = data[:-1], data[1:]
    out = np.zeros(len(data), dtype=bool)
    out[1:] = _SPACE[right] & _VISIBLE[left] | ends[right] & _ALNUM[left]
    return out


def runs(starts: np.ndarray, end: int, size: int) -> list[tuple[int, int]]:
    """Ranges of pieces of some ``size`` bytes together, one piece at least."""
    bounds = np.append(starts, end)
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        out.append((at, to))
        at = to
    return out


def token_lengths(texts: pa.Array, own: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of an Arrow array."""
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    _, offsets, body = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or body is None or places[0] == places[-1]:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(body, np.uint8)[: places[-1]]
    low = int(places[0])
    starts = places[:-1][np.diff(places) > 0]
    if own.ends is not None:
        first = safe_boundaries(data[low:], own.ends)
        first[starts - low] = True
        starts = np.flatnonzero(first) + low
    bounds = np.append(starts, places[-1])
    tokens = np.zeros(len(bounds), np.int64)
    for a, b in runs(starts, int(places[-1]), RUN_BYTES):
        pieces = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(bounds[a : b + 1].copy()), body)
        distinct = pieces.dictionary_encode()
        counted = pa.array(own.lengths(distinct.dictionary.to_numpy(zero_copy_only=False).tolist()))
        tokens[a + 1 : b + 1] = counted.take(distinct.indices).to_numpy()
    before = np.cumsum(tokens)
    at = np.searchsorted(bounds, places)
    return np.diff(places), np.diff(before[at])


def _counts(vocabulary: str, limit: int):
    def run(batches):
        own = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens = token_lengths(batch.column("text"), own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row; one pass without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
        _counts(vocabulary, limit),
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
