"""URL lists as Bloom filter cascades: exact membership for every key the corpus holds.

Level 0 encodes the listed keys. Corpus keys that are not listed but pass it are encoded
by level 1, listed keys that pass level 1 by level 2, and so on until no key is wrong. A
key of the corpus is then listed exactly if it passes level 0 and the rest of the cascade
does not take it back. Pages are judged by projection alone: no join, no shuffle.

The filters are sized by the list, not by the corpus: level 0 has about
``1.44 * log2(keys / listed)`` bits per listed key, the rest less than as much again. They
are the only data that every task gets.

A rule is a host followed by a path (``example.net/en/``): it fits its host and all
subdomains, if the URL's path starts with the rule's. The longest fitting rule decides, the
one with the longer host where two are equally long.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule
and is allowed. Repeated rows are judged alike. Extra columns are ignored; very long hosts
cost no more than the labels that the longest listed host has.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.llm.stages import stored

#: The query's rules, and the hosts that its list blocks.
RULES: tuple[tuple[str, str], ...] = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
BLOCKED_HOSTS: tuple[str, ...] = tuple(
    f"{name}.example.{top}"
    for name in ("adult-x", "casino-win", "cheap-pills", "spam-farm")
    for top in ("com", "net", "org")
)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(
        F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase
    )


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(key, F.lit(level * 1000 + i)), F.lit(bits).cast("long"))
        for i in range(hashes)
    ]


def _encode(keys: DataFrame, level: int, bits: int, hashes: int) -> Level:
    """The filter's 64-bit words; there are ``bits / 64`` of them, whatever ``keys`` holds."""
    spark = keys.sparkSession
    set_words = (
        keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("bit"))
        .groupBy(F.floor(F.col("bit") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("value"))
    )
    size = (bits + 63) // 64
    rows = (
        spark.range(size)
        .join(set_words, F.col("id") == F.col("word"), "left")
        .agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("value", F.lit(0).cast("long")).alias("v")))))
        .first()
    )
    return Level(bits, hashes, tuple(pair["v"] for pair in rows[0]))


def _passes(key: Column, number: int, level: Level) -> Column:
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    hit = F.lit(True)
    for place in _places(key, number, level.bits, level.hashes):
        word = F.get(words, F.floor(place / 64).cast("int"))
        hit = hit & (F.getbit(word, (place % 64).cast("int")) == 1)
    return hit


class Cascade:
    """Exact membership of ``listed`` for all keys of ``universe`` (column ``key``, distinct)."""

    def __init__(self, listed: list[str], universe: DataFrame):
        spark = universe.sparkSession
        keys = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
        others = universe.where(F.col("key").isNotNull()).join(keys, "key", "left_anti")
        n, total = len(set(listed)), max(universe.count(), 1)
        self.levels: list[Level] = []
        # Those the next level encodes, those it must tell them from, and how many it encodes.
        encoded, against, count = keys, others, n
        while count:
            number = len(self.levels)
            rate = min(0.5, max(2.0**-40, math.sqrt(0.5) * n / total)) if number == 0 else 0.5
            hashes = max(1, math.ceil(-math.log2(rate)))
            bits = max(64, math.ceil(count * hashes / math.log(2)))
            level = _encode(encoded, number, bits, hashes)
            self.levels.append(level)
            wrong = stored(against.where(_passes(F.col("key"), number, level)), "cascade")
            encoded, against, count = wrong, encoded, wrong.count()

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        member = F.lit(False)
        for number in reversed(range(len(self.levels))):
            member = _passes(key, number, self.levels[number]) & ~member
        return member


def _split(key: str) -> tuple[str, str]:
    name, slash, rest = key.partition("/")
    return name.lower(), slash + rest


def candidates(host_: Column, path_: Column, keys: list[str]) -> Column:
    """The keys by which a URL could be listed, longest first.

    Only host endings of as many labels, and path beginnings of as many characters, as some
    listed key has: their number depends on the list alone.
    """
    parts = [_split(key) for key in keys]
    labels = sorted({name.count(".") + 1 for name, _ in parts})
    lengths = sorted({len(rest) for _, rest in parts})
    found = []
    for n in labels:
        ending = F.substring_index(host_, ".", -n)
        fits = F.size(F.split(host_, r"\.", n + 1)) >= n
        for size in lengths:
            start = F.substring(path_, 1, size)
            key = F.concat(ending, start)
            found.append(
                F.when(
                    fits & (F.length(start) == size) & (host_ != ""),
                    F.struct(
                        (-F.length(key)).alias("length"), (-F.length(ending)).alias("host"), key.alias("key")
                    ),
                )
            )
    return F.transform(
        F.sort_array(F.filter(F.array(*found), lambda x: x.isNotNull())), lambda x: x["key"]
    )


def judge(
    spark: SparkSession,
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    blocked_hosts: tuple[str, ...] = BLOCKED_HOSTS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict``: the longest fitting rule's action, else whether
    the host or one it belongs to is on the list.
    """
    rules = tuple((action, "".join(_split(key))) for action, key in rules)
    blocked = [f"{name.lower()}" for name in blocked_hosts]
    listed = {
        "allow": [key for action, key in rules if action == "allow"],
        "block": [key for action, key in rules if action == "block"],
    }
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parsed = parsed.select(
        "*",
        candidates(F.col("host"), F.col("path"), listed["allow"] + listed["block"]).alias("_keys")
        if rules
        else F.array().cast("array<string>").alias("_keys"),
        candidates(F.col("host"), F.lit(""), blocked).alias("_hosts")
        if blocked
        else F.array().cast("array<string>").alias("_hosts"),
    )
    universe = stored(
        parsed.select(F.explode(F.concat("_keys", "_hosts")).alias("key")).distinct(), "keys"
    )
    allow, block = Cascade(listed["allow"], universe), Cascade(listed["block"], universe)
    hosts = Cascade(blocked, universe)
    hit = F.get(F.filter("_keys", lambda key: allow.holds(key) | block.holds(key)), 0)
    return (
        parsed.withColumn("rule", hit)
        .withColumn("_listed", F.exists("_hosts", hosts.holds))
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.when(F.col("rule").isNotNull() & allow.holds(F.col("rule")), "allow")
            .when(F.col("rule").isNotNull(), "block")
            .when(F.col("_listed"), "block")
            .otherwise("allow")
            .alias("verdict"),
        )
    )


def _sql() -> str:
    rules = ", ".join(
        "('{}', '{}', '{}')".format(action, *_split(key)) for action, key in RULES
    )
    hosts = ", ".join(f"('{name}')" for name in BLOCKED_HOSTS)
    return f"""
WITH rules(action, h, p) AS (VALUES {rules}), listed(h) AS (VALUES {hosts}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
hits AS (
  SELECT page_id, action, r.h || r.p AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS place
  FROM parsed, rules r
  WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)),
blocked AS (
  SELECT DISTINCT page_id FROM parsed, listed l WHERE host = l.h OR ends_with(host, '.' || l.h))
SELECT p.page_id, host, path, rule,
       coalesce(action, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed p LEFT JOIN hits h ON h.page_id = p.page_id AND place = 1
LEFT JOIN blocked b ON b.page_id = p.page_id"""


SQL = _sql()
