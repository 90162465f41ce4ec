"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one
64-bit number with a bit per failed rule; policies are named masks over these bits, so a
new policy, a comparison of two policies or an ablation is arithmetic on stored numbers and
never looks at a text again. All of it is column functions.

Defined results: a null text has no words and measures 0 throughout. Empty and very long
texts take the same path. Repeated rows each get their ledger row. Null ``doc_id`` and
extra columns are carried, whatever their names, inside the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.llm.stages import stored

GAP = r"[ \t-\r]+"
NOT_GAP = r"[^ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"

#: Bit, name and failing condition of each rule, in whole numbers.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 20 * n_words"),
    (3, "repeated_lines", "n_lines >= 10 AND 100 * n_dup_lines > 30 * n_lines"),
    (4, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    (5, "capitals", "100 * n_capitals > 50 * word_chars"),
)

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals"),
}
CURRENT = "2"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_capitals",
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    bits = {name: bit for bit, name, _ in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _left(text: Column, dropped: str) -> Column:
    """Code points of ``text`` that are left without the ``dropped`` ones."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def _repeated(frame: DataFrame) -> DataFrame:
    """``n_repeat_words``: words inside 3-word windows that the text holds twice or more.

    Windows are hashed and sorted with their places; a window equal to a neighbour in that
    order is repeated. A window covers three words, less where the next one begins earlier.
    """
    word = lambda i, more: F.get("_words", i + more)
    return (
        frame.withColumn(
            "_windows",
            F.when(
                F.col("n_words") >= 3,
                F.sort_array(
                    F.transform(
                        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
                        lambda i: F.struct(
                            F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), i.alias("i")
                        ),
                    )
                ),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        )
        .withColumn(
            "_places",
            F.sort_array(
                F.filter(
                    F.transform(
                        "_windows",
                        lambda x, k: F.when(
                            (x["h"] == F.get("_windows", k - 1)["h"])
                            | (x["h"] == F.get("_windows", k + 1)["h"]),
                            x["i"],
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        .withColumn(
            "n_repeat_words",
            F.aggregate(
                F.transform(
                    "_places",
                    lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - i, F.lit(3))),
                ),
                F.lit(0).cast("long"),
                lambda total, more: total + more,
            ),
        )
        .drop("_windows", "_places")
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), the measurements and ``failed_bits``."""
    frame = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
    )
    frame = frame.withColumn("_words", words(F.col("_text"))).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(NOT_GAP))
    )
    frame = frame.select(
        "row",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        _left(F.col("_text"), GAP).alias("word_chars"),
        _left(F.col("_text"), SYMBOLS.replace("[", "[^") + "+").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _left(F.col("_text"), r"\P{Lu}+").alias("n_capitals"),
    )
    frame = _repeated(frame)
    bits = F.lit(0).cast("long")
    for bit, _, failing in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return frame.select("row", *MEASURES, bits.alias("failed_bits"))


def passes(policy: str) -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """``rule, failing, only_failing, kept_without``: what each rule of a policy costs.

    Ledger rows are counted by their bits first (at most one row per set of rules), the
    rest works on these few counts.
    """
    counts = rows.groupBy(
        F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")
    ).agg(F.count("*").alias("n"))
    wanted = [(name, 1 << bit) for bit, name, _ in RULES if name in POLICIES[policy]]
    per_rule = counts.select(
        "bits",
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in wanted])
        ).alias("r"),
    )
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return per_rule.groupBy("r.rule").agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failing"),
        total(F.col("bits") == F.col("r.bit")).alias("only_failing"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0).alias("kept_without"),
    )


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns.

    The ledger is written first: a condition on its bits would otherwise be pushed below the
    measurements and evaluate them again inside each other.
    """
    rows = stored(ledger(docs).select("row", "failed_bits"), "ledger")
    return rows.where(passes(policy)).select("row.*")


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``doc_id``, the measurements, ``failed_bits``, ``base_failed`` and ``kept``."""
    return ledger(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        *MEASURES,
        "failed_bits",
        (~passes("base")).alias("base_failed"),
        (passes("base") & passes(policy)).alias("kept"),
    )


#: The same rows in SQL.
SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t))),
repeats AS (
  SELECT doc_id, count(DISTINCT i + more) AS n
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS more FROM windows WHERE times > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(text, '\\P{Lu}+', '', 'g')) AS BIGINT) AS n_capitals
  FROM t LEFT JOIN repeats r ON r.doc_id = t.doc_id),
b AS (
  SELECT *, """ + " + ".join(
    f"CASE WHEN {failing} THEN {1 << bit} ELSE 0 END" for bit, _, failing in RULES
) + f""" AS bits FROM m)
SELECT doc_id, {", ".join(MEASURES)}, CAST(bits AS BIGINT) AS failed_bits,
       bits & {mask("base")} <> 0 AS base_failed, bits & {mask("base") | mask(CURRENT)} = 0 AS kept
FROM b"""
