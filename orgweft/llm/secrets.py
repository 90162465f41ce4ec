"""Secret scans judged by corpus-wide ownership of each candidate value.

Texts are scanned once for three fixed kinds (assignments, access ids, hexadecimal runs)
and for bare tokens that look random. Each candidate's value is reduced to a hash, and the
hash is aggregated over the whole corpus by distinct repositories and owners. A value is a
copied example (shared) if ``many_owners`` hold it, or if fewer do, two at least, and it lies
in ``many_repositories``. One that is not shared and looks random is live. One owner's value
is that owner's, in however many of its repositories it lies. Fixed kinds stay spans either
way; bare tokens become spans (``live``) only if they are owner-specific.

An owner is a ``source``; every document stands for a repository of its source.

Defined results: a null text is empty; a null ``source`` is one owner of its own; repeated
rows get the same spans, and add neither repositories nor owners; extra columns are carried
by ``redact`` and ignored elsewhere. Positions count code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweft.llm.stages import stored

KINDS = ("assign", "access", "hex", "live")
MANY_OWNERS = 4
MANY_REPOSITORIES = 20

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
MIN_BITS = 3.2

_HEX = bytes(c if c in b"0123456789abcdef" else 32 for c in range(256))
_TOKEN = bytes(
    c if chr(c).isascii() and (chr(c).isalnum() or c in b"+/_=-") else 32 for c in range(256)
)
_DIGITS = frozenset(b"0123456789")

SPAN = "struct<kind:int,start:bigint,end:bigint,value:string,random:boolean>"


def entropy(value: str) -> float:
    """Bits per character."""
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())


def looks_random(value: str) -> bool:
    """Digits and letters mixed, with many different characters."""
    return (
        any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
        and entropy(value) >= MIN_BITS
    )


def find(text: str | None) -> list[dict]:
    """Spans of the fixed kinds, and bare random-looking tokens outside them (kind 3)."""
    if not text:
        return []
    data = text.encode("utf-8", "replace")
    found: list[tuple[int, int, int, str]] = []
    lower = data.lower()
    if any(word in lower for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((0, m.start(), m.end(), m.group(2)))
    if b"AKIA" in data:
        found += [(1, *m.span(), m.group()) for m in ACCESS.finditer(text)]
    if any(len(run) >= 24 for run in data.translate(_HEX).split()):
        found += [(2, *m.span(), m.group()) for m in HEX.finditer(text)]
    if any(len(run) >= 20 and not _DIGITS.isdisjoint(run) for run in data.translate(_TOKEN).split()):
        taken = [(start, end) for _, start, end, _ in found]
        for m in TOKEN.finditer(text):
            if looks_random(m.group()) and not any(
                start < m.end() and m.start() < end for start, end in taken
            ):
                found.append((3, *m.span(), m.group()))
    return [
        {
            "kind": kind,
            "start": start,
            "end": end,
            "value": hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:32],
            "random": looks_random(value),
        }
        for kind, start, end, value in sorted(found, key=lambda x: (x[1], x[0]))
    ]


_SPANS = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("value", pa.string()),
            ("random", pa.bool_()),
        ]
    )
)


def _scan(batches):
    for batch in batches:
        spans = [find(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), batch.column("key"), pa.array(spans, _SPANS)],
            names=["doc_id", "source", "key", "spans"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", F.xxhash64("doc_id", "text").alias("key")
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, source, key, spans`` of every row; written once, as it is read three times."""
    keyed = _keyed(docs)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return stored(
        keyed.mapInArrow(_scan, f"doc_id {kind}, source string, key bigint, spans array<{SPAN}>"), "secrets"
    )


def ownership(rows: DataFrame) -> DataFrame:
    """``value, repositories, owners``: in how many places each candidate value occurs.

    Values are reduced to one row per repository, then per owner, before they are counted,
    so that a value in a third of all rows meets in no single task.
    """
    spans = rows.where(F.size("spans") > 0).select("source", "doc_id", F.explode("spans.value").alias("value"))
    repositories = spans.groupBy("value", "source", "doc_id").agg(F.lit(1).alias("one"))
    owners = repositories.groupBy("value", "source").agg(F.count("*").alias("n"))
    return owners.groupBy("value").agg(
        F.sum("n").alias("repositories"), F.count("*").alias("owners")
    )


def judged(
    rows: DataFrame, many_owners: int = MANY_OWNERS, many_repositories: int = MANY_REPOSITORIES
) -> DataFrame:
    """``key, spans``: for rows with candidates, their spans with ``live`` and ``shared``.

    ``shared``: ``many_owners`` or more hold the value, or two or more do in
    ``many_repositories`` or more. ``live``: it is not shared and looks random. Bare tokens
    that are not live are left out.
    """
    shared = (F.col("owners") >= many_owners) | (
        (F.col("owners") >= 2) & (F.col("repositories") >= many_repositories)
    )
    values = stored(ownership(rows).select("value", shared.alias("copied")), "ownership")
    spans = (
        rows.where(F.size("spans") > 0)
        .dropDuplicates(["key"])
        .select("key", F.explode("spans").alias("s"))
        .join(values, F.col("s.value") == values["value"])
        .select(
            "key",
            F.struct(
                F.col("s.start").alias("start"),
                F.col("s.kind").alias("kind"),
                F.col("s.end").alias("end"),
                F.col("copied").alias("shared"),
                (F.col("s.random") & ~F.col("copied")).alias("live"),
            ).alias("s"),
        )
        .where((F.col("s.kind") < 3) | F.col("s.live"))
    )
    return spans.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def _joined(spans, kinds: int):
    """``kind:start:end`` of the spans below kind number ``kinds``, comma-joined."""
    return F.array_join(
        F.transform(
            F.filter(spans, lambda s: s["kind"] < kinds),
            lambda s: F.concat_ws(
                ":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"]
            ),
        ),
        ",",
    )


def _of_kind(kind: int):
    # A second argument of the lambda, even one with a default, would be the position.
    return lambda s: s["kind"] == kind


def report(
    docs: DataFrame, many_owners: int = MANY_OWNERS, many_repositories: int = MANY_REPOSITORIES
) -> DataFrame:
    """One row per document: counts per kind, digest of the fixed spans, all spans, and how
    many are live and how many are shared examples.
    """
    rows = scan(docs)
    spans = judged(rows, many_owners, many_repositories).withColumnsRenamed({"key": "_key", "spans": "found"})
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,shared:boolean,live:boolean>>")
    full = rows.join(spans, F.col("key") == F.col("_key"), "left").select(
        "doc_id", F.coalesce("found", none).alias("s")
    )
    n = lambda test: F.size(F.filter("s", test)).cast("long")
    return full.select(
        "doc_id",
        *[n(_of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined("s", 3).cast("binary"), 256).alias("base_sha256"),
        _joined("s", 4).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"),
        n(lambda s: s["shared"]).alias("n_shared"),
    )


def redact(
    docs: DataFrame,
    many_owners: int = MANY_OWNERS,
    note: str = "[secret]",
    many_repositories: int = MANY_REPOSITORIES,
) -> DataFrame:
    """``docs`` with every span that is not a shared example replaced by ``note``; a column
    ``n_chars`` follows the text. Rows without such spans come back unchanged.
    """
    names = docs.columns
    spans = judged(scan(docs), many_owners, many_repositories)
    cuts = F.expr("filter(spans, s -> NOT s.shared)")
    found = spans.select(F.col("key").alias("_key"), cuts.alias("_cuts")).where(F.size("_cuts") > 0)
    # Spans may overlap across kinds: what lies between them is kept, by the furthest end so far.
    piece = F.aggregate(
        "_cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda done, s: F.struct(
            F.when(
                s["start"] >= done["at"],
                F.concat(
                    done["out"],
                    F.substring("text", done["at"].cast("int") + 1, (s["start"] - done["at"]).cast("int")),
                    F.lit(note),
                ),
            )
            .otherwise(done["out"])
            .alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        ),
    )
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        "text",
        F.xxhash64("doc_id", "text").alias("_at"),
    )
    done = (
        row.join(found, F.col("_at") == F.col("_key"), "left")
        .withColumn("_done", F.when(F.col("_cuts").isNotNull(), piece))
        .withColumn(
            "_text",
            F.when(
                F.col("_done").isNotNull(),
                F.concat("_done.out", F.substring("text", F.col("_done.at").cast("int") + 1, F.length("text"))),
            ).otherwise(F.col("text")),
        )
    )

    def column(name: str):
        if name == "text":
            return F.col("_text").alias("text")
        if name == "n_chars":
            kept = F.col("_row.n_chars")
            return (
                F.when(F.col("_done").isNotNull(), F.length("_text").cast(docs.schema["n_chars"].dataType))
                .otherwise(kept)
                .alias("n_chars")
            )
        return F.col(f"_row.`{name}`").alias(name)

    return done.select(*[column(name) for name in names])
