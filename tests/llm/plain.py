"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, h int"


def rows(spark, texts, ids=None):
    """Documents with two extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, "en", f"s{n % 3}", None if t is None else len(t), "x", n) for n, (i, t) in enumerate(zip(ids, texts, strict=True))],
        SCHEMA,
    )


ODD = [None, "", " \n\t ", "a", "a b", "é ü\x0bñ", "x" * 5000, "one two three four five six"]


def prose(seed: int, words: int, vocabulary: int = 400) -> list[str]:
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(words)]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingle_set(text, size):
    own = WORD.findall(lower(text))
    if not own:
        return frozenset()
    if len(own) < size:
        return frozenset([tuple(own)])
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1))


def link_components(docs, size, percent):
    """``id -> smallest id reachable``."""
    sets = [(i, shingle_set(t, size)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i, _ in sets}


def kept_words(docs, size):
    """Per row: words, removed words, the rest joined."""
    least = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in docs:
        own = WORD.findall(t or "")
        for at in range(len(own) - size + 1):
            window = tuple(own[at : at + size])
            least[window] = min(least.get(window, float("inf")), order(i))
    out = []
    for i, t in docs:
        own = WORD.findall(t or "")
        gone = set()
        for at in range(len(own) - size + 1):
            if least[tuple(own[at : at + size])] < order(i):
                gone |= set(range(at, at + size))
        out.append((i, len(own), len(gone), " ".join(x for n, x in enumerate(own) if n not in gone)))
    return out


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
