"""Draws by permutation and percentiles by counts, against plain Python."""

from __future__ import annotations

import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from orgweft.functions.permutation import draws, permuted, side_of
from orgweft.functions.ranking import running_total
from orgweft.operators.evaluate import percentiles


def plain(number: int, side: int, seed: int) -> int:
    high, low = divmod(number, side)
    for place in range(4):
        value = int(hashlib.sha256(f"{seed}:{place}:{low}".encode()).hexdigest()[:15], 16)
        high, low = low, (high + value) % side
    return high * side + low


def test_permutation(spark):
    side = 23
    got = spark.range(side * side).select("id", permuted(F.col("id"), side, 5).alias("to")).collect()
    assert {r.id: r.to for r in got} == {i: plain(i, side, 5) for i in range(side * side)}
    assert len({r.to for r in got}) == side * side


@pytest.mark.parametrize("total, size", [(0, 5), (1, 5), (2, 2), (10, 3), (500, 499), (500, 9000), (10**17, 50)])
def test_draws(spark, total, size):
    got = [r.number for r in draws(spark, total, size, 7).collect()]
    assert len(got) == len(set(got)) == min(size, total)
    assert all(0 <= n < total for n in got)
    expected, side = [], side_of(total)
    for i in range(min(size, total)):
        number = plain(i, side, 7)
        while number >= total:
            number = plain(number, side, 7)
        expected.append(number)
    assert sorted(got) == sorted(expected)


def test_running_total(spark):
    rows = [(i * 37 % 101, i) for i in range(101)]
    frame = spark.createDataFrame(rows, "k INT, n BIGINT")
    got = {r.k: r.upto for r in running_total(frame, [F.col("k")], "n", "upto").collect()}
    assert got == {k: sum(n for other, n in rows if other <= k) for k, _ in rows}


def test_percentiles(spark):
    groups = {
        "one": [3.0],
        "two": [1.0, 4.0],
        "ties": [2.0] * 19 + [5.0],
        "spread": [float(i * i % 97) for i in range(60)],
        "some null": [None, 6.0, 8.0, None],
        "no value": [None],
        None: [7.0, 7.0, 9.0],
    }
    rows = [(g, x) for g, values in groups.items() for x in values]

    def expected(name, values):
        known = sorted(x for x in values if x is not None)
        if not known:
            return (name, len(values), None, None)
        return (name, len(values), statistics.median(known), known[-(-len(known) * 95 // 100) - 1])

    wanted = [expected(g or "all", values) for g, values in groups.items()]
    wanted.append(expected("all", [x for _, x in rows]))
    got = percentiles(spark.createDataFrame(rows, "g STRING, x DOUBLE"), "g", "x").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, wanted))
    empty = percentiles(spark.createDataFrame([], "g STRING, x DOUBLE"), "g", "x").collect()
    assert [tuple(r) for r in empty] in ([], [("all", 0, None, None)])
