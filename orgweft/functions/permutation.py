"""A keyed permutation of numbers as a column expression: the k-th draw is a formula.

Numbers below ``side * side`` are two digits to the base ``side``. Each round adds a keyed
hash of one digit to the other and swaps them, which can be undone, so different numbers stay
different. A smaller range is reached by walking on until a number falls into it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.session import durable

ROUNDS = 4
#: Hexadecimal digits of the hash that are used: 60 bits.
DIGITS = 15


def side_of(total: int) -> int:
    """The smallest side whose square holds ``total`` numbers."""
    return math.isqrt(total - 1) + 1 if total > 0 else 0


def permuted(number: Column, side: int, seed: int) -> Column:
    """Where a number below ``side * side`` goes."""

    def round_(digits: Column, place: Column) -> Column:
        key = F.concat_ws(":", F.lit(str(seed)), place.cast("string"), digits["low"].cast("string"))
        value = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, DIGITS), 16, 10).cast("bigint")
        return F.struct(
            digits["low"].alias("high"), F.pmod(digits["high"] + value, F.lit(side).cast("bigint")).alias("low")
        )

    whole = number.cast("bigint")
    start = F.struct(
        F.call_function("div", whole, F.lit(side).cast("bigint")).alias("high"),
        F.pmod(whole, F.lit(side).cast("bigint")).alias("low"),
    )
    end = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, round_)
    return end["high"] * F.lit(side).cast("bigint") + end["low"]


def draws(spark: SparkSession, total: int, size: int, seed: int) -> DataFrame:
    """``number``: ``size`` different numbers below ``total`` (all, if there are fewer).

    Nothing is sorted and no draw is repeated; few numbers need a second walk, as the square
    is larger than ``total`` by two sides at most.
    """
    size = min(size, total)
    side = side_of(total)
    if size <= 0:
        return spark.range(0).select(F.col("id").alias("number"))
    number = F.col("number")
    found = durable(spark.range(size).select(permuted(F.col("id"), side, seed).alias("number")))
    while not found.where(number >= total).isEmpty():
        found = durable(
            found.select(F.when(number >= total, permuted(number, side, seed)).otherwise(number).alias("number"))
        )
    return found
